"""The prospect data folder as one object (the file layout the original
application reads): every table is a lazily built, declared-type DataFrame,
and the flows L1-L4 are one call each.

    data = ProspectData(spark, "/data")
    ranked = data.ranked_companies()           # L1 (S3: J2 -> P1 -> W1 -> J3)
    report = data.startup_validation()          # L3 (raises on a blocking gate)
    rankings = data.industry_rankings()         # L2
    data.export(ids, "/out/export", filter_info)  # J7 + S17

Paths can point at any Hadoop-compatible store (HDFS, S3, ABFS).
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, scoring
from ..operators.filters import PageFilter, apply_page_filter
from ..operators.joins import small_side
from ..sources import config_files, readers, schemas, writers
from . import export as export_plan
from . import industry, profile, ranked

# FIXED VALUES: relative file layout of the data folder
LAYOUT = {
    "exclusions": "config/exclusions.yaml",
    "channels": "config/channels.yaml",
    "naics_targets": "config/naics_target.yaml",
    "six_digit_targets": "config/naics_config.yaml",
    "sqft_codes": "config/sqft_codes.yaml",
    "companies": "processed/companies.csv",
    "golden_buildings": "processed/golden_buildings.csv",
    "buildings": "processed/buildings.csv",
    "scored_final": "scoring/scored_companies_final.csv",
    "scored": "scoring/scored_companies.csv",
    "penetration": "processed/penetration_by_company.csv",
    "contacts": "processed/contact_summary.csv",
    "research_enrichment": "research/research_enrichment.json",
    "research_documents": "research/research_documents",
    "research": "scoring/company_icp_scores_with_research.csv",
    "churn": "scoring/churn_predictions.csv",
    "er_log": "processed/entity_resolution_log.csv",
    "diagnostics": "scoring/scoring_diagnostics.json",
    "crm_companies": "raw/hubspot_companies.csv",
    "crm_interactions": "raw/hubspot_interactions.csv",
    "naics_metrics": "scoring/naics_metrics.csv",
    "naics_codes": "config/naics_codes.csv",
}


class ProspectData:
    """Lazy access to the tables of one data folder (one ``data_dir``
    argument for every path, H22)."""

    def __init__(self, spark: SparkSession, data_dir: str, strategy: str = "distributed"):
        self.spark, self.root, self.strategy = spark, data_dir.rstrip("/"), strategy
        self._cache: dict[str, DataFrame | None] = {}

    def path(self, key: str) -> str:
        return f"{self.root}/{LAYOUT[key]}"

    def _get(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    # ------------------------------------------------------------ tables
    def companies(self) -> DataFrame:
        return self._get("companies", lambda: readers.load_companies(self.spark, self.path("companies")))

    def buildings(self) -> DataFrame:
        return self._get("buildings", lambda: readers.load_buildings(
            self.spark, self.path("golden_buildings"), self.path("buildings"), self.companies()))

    def scored_raw(self) -> DataFrame:
        return self._get("scored_raw", lambda: readers.load_scored(
            self.spark, self.path("scored_final"), self.path("scored")))

    def exclusion_codes(self) -> list[str]:
        return config_files.excluded_codes(self.path("exclusions"))

    def channels(self) -> tuple[dict, str]:
        """(channels, default channel) of the folder's own document, which must exist."""
        return config_files.load_channels(self.path("channels"))

    def channel_assignment(self) -> DataFrame:
        """J13 + F11 by the folder's document: channel of every scored company, and the channel's weights."""
        channels, default = self.channels()
        out = scoring.assign_channel(self.scored_raw().select("company_id", "primary_naics"), scoring.channel_table(self.spark, channels),
                                     default_channel=default)
        w = scoring.channel_weights(self.spark, channels)
        return out.join(small_side(w.groupBy("channel_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("component", "weight")))).alias("weights"))), on="channel_id", how="left")

    def target_companies(self) -> DataFrame:
        """P17 + W6 by the folder's documents: companies of target industries, capped, largest first."""
        t = scoring.targets_table(self.spark, config_files.load_naics_targets(self.path("naics_targets")))
        c = self.companies().withColumn("naics_4digit", F.substring("primary_naics", 1, 4))
        return scoring.cap_industries(c, t, [F.col("building_count_estimate").desc_nulls_last(), F.col("company_id")])

    def large_buildings(self) -> DataFrame:
        """P16 + J14 by the folder's document of square-footage codes."""
        codes = scoring.sqft_table(self.spark, config_files.load_sqft_codes(self.path("sqft_codes")))
        return scoring.apply_sqft_rule(self.buildings(), codes)

    def _optional(self, key, load, schema):
        def build():
            try:
                return load(self.spark, self.path(key))
            except readers.DataLoadError:
                return readers.empty_frame(self.spark, schema)
        return self._get(key, build)

    def penetration(self) -> DataFrame:
        """Optional on the ranked page: missing file -> no rates."""
        return self._optional("penetration", readers.load_penetration, schemas.PENETRATION)

    def contacts(self) -> DataFrame:
        """Optional on the detail page: missing file -> no contacts."""
        return self._optional("contacts", readers.load_contact_summary, schemas.CONTACT_SUMMARY)

    def research(self) -> DataFrame:
        return self._get("research", lambda: readers.load_company_research(self.spark, self.path("research")))

    def churn(self) -> DataFrame:
        return self._get("churn", lambda: readers.load_churn_predictions(self.spark, self.path("churn")))

    def crm_companies(self) -> DataFrame:
        return self._get("crm", lambda: readers.load_crm_companies(self.spark, self.path("crm_companies")))

    def naics_metrics(self) -> DataFrame:
        return self._get("metrics", lambda: readers.load_naics_metrics(self.spark, self.path("naics_metrics")))

    def naics_codes(self) -> DataFrame:
        return self._get("codes", lambda: readers.load_naics_codes(self.spark, self.path("naics_codes")))

    def er_log(self) -> DataFrame | None:
        return self._get("er_log", lambda: readers.load_entity_resolution_log(self.spark, self.path("er_log")))

    def diagnostics(self) -> DataFrame | None:
        return self._get("diag", lambda: readers.load_scoring_diagnostics(self.spark, self.path("diagnostics")))

    def research_documents(self) -> DataFrame:
        """S9 in bulk: every per-company JSON document of the folder."""
        return self._get("docs", lambda: readers.load_research_documents(self.spark, self.path("research_documents")))

    # ------------------------------------------------------------- flows
    def document_report(self) -> DataFrame:
        """D22 + D24 + D25 per research document: words, flag counts, validity
        reason, and whether stored flag counts (old score format) disagree."""
        from ..functions import text as tx
        d = self.research_documents()
        doc = F.col("research_document")
        out = d.select("company_id", tx.company_name_or_unknown(F.col("company_name")).alias("company_name"),
                       *tx.document_summary(doc),
                       tx.document_validity(doc, F.col("status"), F.col("document_stats.word_count")).alias("reason"))
        scored = self.scored_raw()
        if {"urgent_flags", "action_flags"} <= set(scored.columns):
            stored = scored.select("company_id", F.col("urgent_flags").alias("stored_urgent"),
                                   F.col("action_flags").alias("stored_action"))
            out = out.join(stored, on="company_id", how="left").withColumn(
                "flag_mismatch", tx.flags_differ(F.col("stored_urgent"), F.col("urgent_flags"))
                | tx.flags_differ(F.col("stored_action"), F.col("action_flags")))
        return out

    def ranked_companies(self) -> DataFrame:
        """L1 stage 1 (S3): J2 -> P1 -> W1 -> J3 (the re-rank checkpoints once)."""
        return self._get("ranked", lambda: ranked.prepare_scored(
            self.scored_raw(), self.companies(), self.exclusion_codes(), self.strategy))

    def enriched(self) -> DataFrame:
        """L1 stage 2: J4, J5 (CRM data missing -> all False), J6."""
        return ranked.enrich(self.ranked_companies(), self.companies(), self.crm_companies(), self.penetration())

    def ranked_view(self, spec: PageFilter | None = None) -> DataFrame:
        """L1 stages 4-5: P2 filters, O4 order, W2 global rank."""
        return ranked.ranked_view(self.enriched(), spec, self.strategy)

    def startup_validation(self) -> dict:
        """L3: blocking gates raise ``DataQualityError``; returns the rest."""
        return quality.run_startup_validation(self.spark, self.ranked_companies(), self.companies(),
                                              self.buildings(), self.er_log(), self.diagnostics())

    def industry_rankings(self) -> DataFrame:
        """L2: A1 -> J9 -> A8/D7 -> O1 (missing metrics -> empty, full schema)."""
        return industry.industry_rankings(self.spark, self.ranked_companies(), self.naics_metrics(),
                                          self.naics_codes())

    def company_profiles(self, ids: DataFrame) -> DataFrame:
        """L4 / J8 for a set of ids."""
        return profile.company_profile(self.companies(), self.ranked_companies(), self.buildings(), ids,
                                       self.contacts(), self.churn(), self.research())

    def export(self, ids: DataFrame | None, out_dir: str, filter_info: Mapping | None = None,
               fmt: str = "parquet", spec: PageFilter | None = None) -> list[str]:
        """J7 + S17: the ranking, reasoning, research and manifest tables of
        the selected ids (default: every id of the filtered view)."""
        view = self.enriched()
        if ids is None:
            ids = apply_page_filter(view, spec or PageFilter()).select("company_id")
        flags = view.select("company_id", "in_hubspot")
        run = export_plan.Export(export_plan.merge_export_data(self.ranked_companies(), self.research(), self.companies(), ids, flags))
        stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        # the manifest comes last: an export folder without one is not complete
        tables = {"Company Rankings": run.rankings(), "ICP Detailed Reasoning": run.reasoning(), "Web Research Details": run.research(),
                  "Export Metadata": run.manifest(filter_info, stamp)}
        return writers.write_export(tables, out_dir, fmt)
