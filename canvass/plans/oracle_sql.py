"""ANSI SQL (DuckDB dialect) for every oracle-checked query.

The carrier derivations are written a second time here, independently of the
DataFrame code in ``carriers.py``, as common table expressions. Output types
are cast to the Spark types (BIGINT counts, INTEGER ranks, DOUBLE scores).
"""

from __future__ import annotations

from .. import config
from .carriers import OWN_CHANNELS, OWN_SIX_DIGIT, OWN_SQFT, OWN_TARGETS
from .carriers import CARRIER_SECTORS, CUSTOMER_MIN_FINISHED, SCORE_CENTS_FULL, SEGMENT_DIGITS

_SECTOR_LIST = "[" + ", ".join(f"'{s}'" for s in CARRIER_SECTORS) + "]"
_SEG_CASE = "CASE c.c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_DIGITS.items()) + " ELSE '00' END"
_EXCL = ", ".join(f"'{c}'" for c in config.excluded_naics_codes())

CTE = {
    "cust_codes": f"""cust_codes AS (
  SELECT c.c_custkey, CAST(c.c_custkey AS VARCHAR) AS company_id, c.c_name, c.c_acctbal, c.c_nationkey, c.c_mktsegment,
         coalesce({_SECTOR_LIST}[c.c_nationkey + 1], '99') || {_SEG_CASE} AS naics_4digit,
         coalesce({_SECTOR_LIST}[c.c_nationkey + 1], '99') || {_SEG_CASE}
           || CASE WHEN c.c_acctbal >= 5000 THEN '1018' ELSE '1005' END AS primary_naics,
         g.r_name AS city, g.n_name AS state
  FROM customer c
  LEFT JOIN (SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) g
    ON c.c_nationkey = g.n_nationkey)""",
    "order_figs": """order_figs AS (
  SELECT o_custkey AS c_custkey, CAST(count(*) AS BIGINT) AS n_orders,
         CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_finished,
         CAST(count_if(o_orderpriority = '1-URGENT') AS BIGINT) AS n_urgent,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value_cents
  FROM orders GROUP BY o_custkey)""",
    "companies": """companies AS (
  SELECT cc.company_id, cc.c_name AS name, cc.primary_naics, cc.naics_4digit,
         cc.c_acctbal / 100.0 AS hq_latitude, -cc.c_acctbal / 50.0 AS hq_longitude,
         CAST(f.n_orders AS INTEGER) AS building_count_estimate, CAST(f.n_orders AS INTEGER) AS building_count,
         'https://www.' || lower(replace(cc.c_name, '#', '')) || '.example.com/about' AS website,
         CASE WHEN cc.c_acctbal < 2000 THEN 'S' WHEN cc.c_acctbal < 5000 THEN 'C'
              WHEN cc.c_acctbal < 8000 THEN '+' ELSE 'G' END AS growing_business_code,
         CAST(f.n_finished AS INTEGER) AS contacts_count, cc.city, cc.state,
         CAST(f.n_orders * 10 AS INTEGER) AS employees, f.value_cents / 100.0 AS sales_volume,
         CAST(to_json({'first_name': 'Pat', 'last_name': cc.c_name,
                       'job_titles': [upper(substr(cc.c_mktsegment, 1, 1)) || lower(substr(cc.c_mktsegment, 2)), 'Buyer'],
                       'management_level': lower(cc.c_mktsegment) || '_manager'}) AS VARCHAR) AS primary_contact
  FROM cust_codes cc LEFT JOIN order_figs f ON cc.c_custkey = f.c_custkey
  WHERE cc.c_acctbal >= 0)""",
    "scored": f"""scored AS (
  SELECT cc.company_id, cc.c_name AS company_name, cc.primary_naics, cc.naics_4digit,
         CASE WHEN f.n_finished >= {CUSTOMER_MIN_FINISHED}
              THEN least(CAST(100 AS DOUBLE), CAST(f.value_cents AS DOUBLE) / {float(SCORE_CENTS_FULL)})
              ELSE {config.FINAL_NAICS_WEIGHT} * (40.0 + cc.c_nationkey * CAST(2 AS DOUBLE))
                   + {config.FINAL_COMPANY_WEIGHT} * least(CAST(100 AS DOUBLE), CAST(f.value_cents AS DOUBLE) / {float(SCORE_CENTS_FULL)})
         END AS final_score,
         40.0 + cc.c_nationkey * CAST(2 AS DOUBLE) AS naics_attractiveness_score,
         least(CAST(100 AS DOUBLE), CAST(f.value_cents AS DOUBLE) / {float(SCORE_CENTS_FULL)}) AS company_opportunity_score,
         CASE WHEN f.n_finished >= {CUSTOMER_MIN_FINISHED} THEN 'customer_expansion' ELSE 'prospect' END AS scoring_path,
         f.n_finished >= {CUSTOMER_MIN_FINISHED} AS is_customer,
         CAST(cc.c_nationkey + 1 AS INTEGER) AS rank, cc.city, cc.state,
         greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), cc.c_acctbal / 100.0)) AS icp_fit_score,
         cc.c_custkey IN (SELECT doc_id FROM documents) AS has_research_doc
  FROM cust_codes cc JOIN order_figs f ON cc.c_custkey = f.c_custkey)""",
    "buildings": """buildings AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS building_id, CAST(o_custkey AS VARCHAR) AS company_id,
         o_totalprice / 5000.0 - 5.0 AS latitude, -o_totalprice / 2500.0 AS longitude,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'manual' WHEN '2-HIGH' THEN 'hubspot' ELSE 'dataaxle' END AS source,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_served,
         CAST(least(8, CAST(floor(o_totalprice / 62500) AS INTEGER) + 1) AS VARCHAR) AS square_footage_code
  FROM orders)""",
    "filtered": f"""filtered AS (
  SELECT * FROM scored
  WHERE company_id IN (SELECT company_id FROM companies)
    AND primary_naics IS NOT NULL AND primary_naics NOT IN ({_EXCL}))""",
    "prepared": """prepared AS (
  SELECT r.*, CAST(coalesce(b.building_count, 0) AS INTEGER) AS building_count
  FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY primary_naics
                 ORDER BY final_score DESC NULLS LAST, rank ASC NULLS LAST, company_id ASC NULLS LAST) AS BIGINT) AS rank)
        FROM filtered) r
  LEFT JOIN (SELECT company_id, min(building_count) AS building_count FROM companies GROUP BY company_id) b
    ON r.company_id = b.company_id)""",
}

def _d(x) -> str:
    """A DOUBLE literal that round-trips the Python float exactly."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


_W = config.NAICS_WEIGHTS
_LN_FULL = _d(__import__("math").log(config.MARKET_SIZE_FULL))


def f1_sql(icp, market, conc, bld, rpb, churn, ticket) -> str:
    n = _d(config.NEUTRAL_COMPONENT)
    parts = [(_W["icp_fit"], icp), (_W["market_size"], market), (_W["revenue_concentration"], conc),
             (_W["building_count"], bld), (_W["revenue_per_building"], rpb), (_W["churn_health"], churn),
             (_W["ticket_health"], ticket)]
    return " + ".join(f"{_d(w)} * coalesce({c}, {n})" for w, c in parts)


def sector_sql(code: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v} (' || {code} || ')'" for k, v in config.SECTOR_NAMES)
    return f"CASE substr({code}, 1, 2) {whens} ELSE 'NAICS ' || {code} END"


def generic_sql(desc: str) -> str:
    return f"({desc} IS NULL OR starts_with({desc}, 'NAICS ') OR trim({desc}) = '')"


def anchored_sql(x: str, anchors) -> str:
    """Log scale through two stated examples, clamped to 0..100."""
    (x0, s0), (x1, s1) = anchors
    log = __import__("math").log
    return (f"CASE WHEN CAST({x} AS DOUBLE) > 0 THEN least({_d(100)}, greatest({_d(0)}, {_d(s0)} + {_d((s1 - s0) / (log(x1) - log(x0)))}"
            f" * (ln(CAST({x} AS DOUBLE)) - {_d(log(x0))}))) WHEN {x} IS NOT NULL THEN {_d(0)} END")


_EVEN = config.REVENUE_PER_BUILDING_EVEN
_PER_BUILDING = [(v / _EVEN, s) for v, s in config.REVENUE_PER_BUILDING_ANCHORS]
_SERVED = "o_orderpriority IN ('1-URGENT', '2-HIGH')"

CTE["served_revenue"] = f"""served_revenue AS (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, cc.naics_4digit, CAST(round(o_totalprice * 100) AS BIGINT) AS revenue_cents
  FROM orders JOIN cust_codes cc ON o_custkey = cc.c_custkey WHERE {_SERVED})"""

_INLINE = ", ".join("('{}', '{}', 1)".format(k, v.replace("'", "''")) for k, v in config.SUPPLEMENTARY_DESCRIPTIONS.items())

CTE["metrics"] = f"""li_per_order AS (
  SELECT l_orderkey, count(*) AS n_lines, count_if(l_returnflag = 'R') AS n_returned,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pct
  FROM lineitem GROUP BY l_orderkey),
per_cust AS (
  SELECT o.o_custkey AS c_custkey, sum(n_lines) AS n_lines, sum(n_returned) AS n_returned, sum(disc_pct) AS disc_pct,
         count(*) AS n_orders, count_if(o.o_orderstatus = 'F') AS n_finished,
         count_if(o.o_orderpriority = '1-URGENT') AS n_urgent, count_if({_SERVED}) AS n_served,
         sum(CASE WHEN {_SERVED} THEN CAST(round(o.o_totalprice * 100) AS BIGINT) ELSE 0 END) AS served_cents
  FROM li_per_order li JOIN orders o ON li.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
per_code AS (
  SELECT cc.naics_4digit AS naics_code, CAST(sum(n_lines) AS BIGINT) AS n_lines,
         CAST(sum(n_returned) AS BIGINT) AS n_returned, CAST(sum(disc_pct) AS BIGINT) AS disc_pct,
         CAST(sum(n_orders) AS BIGINT) AS n_orders, CAST(sum(n_finished) AS BIGINT) AS n_finished,
         CAST(sum(n_urgent) AS BIGINT) AS n_urgent, CAST(sum(n_served) AS BIGINT) AS n_served,
         CAST(sum(served_cents) AS BIGINT) AS served_cents, max(cc.c_mktsegment) AS segment
  FROM per_cust p JOIN cust_codes cc ON p.c_custkey = cc.c_custkey GROUP BY cc.naics_4digit),
metric_parts AS (
  SELECT *, {_d(100)} * n_finished / n_orders AS icp,
         round(CASE WHEN CAST(n_lines AS DOUBLE) > 0 THEN least({_d(100)}, greatest({_d(0)},
               {_d(100)} * ln(CAST(n_lines AS DOUBLE)) / {_LN_FULL})) END, 4) AS market,
         {_d(100)} - {_d(100)} * n_returned / n_lines AS churn,
         {_d(100)} - {_d(100)} * n_urgent / n_orders AS ticket,
         least({_d(100)}, greatest({_d(0)}, disc_pct / n_lines / {_d(100)} / {_d(config.PROFIT_MARGIN_FULL)} * {_d(100)})) AS profit,
         round({anchored_sql(f"({_d(100)} * served_cents / nullif((SELECT sum(served_cents) FROM per_code), 0))", config.REVENUE_CONCENTRATION_ANCHORS)}, 4) AS conc,
         round({anchored_sql("n_served", config.BUILDING_COUNT_ANCHORS)}, 4) AS bld,
         round({anchored_sql("(CAST(served_cents AS DOUBLE) / nullif(n_served, 0) / (SELECT median(revenue_cents) FROM served_revenue))", _PER_BUILDING)}, 4) AS rpb
  FROM per_code),
metrics AS (
  SELECT naics_code,
         CASE WHEN segment = 'MACHINERY' THEN 'Machinery Buyers ' || naics_code ELSE 'NAICS ' || naics_code END AS naics_description,
         'Proven demand from ' || lower(segment) || ' buyers' AS icp_fit_reasoning,
         {f1_sql('icp', 'market', 'conc', 'bld', 'rpb', 'churn', 'ticket')} AS attractiveness_score,
         icp AS icp_fit_score, profit AS profitability_score, market AS market_size_score,
         conc AS revenue_concentration_score, bld AS building_count_score, rpb AS revenue_per_building_score,
         churn AS churn_health_score, ticket AS ticket_health_score, n_lines AS market_size_count
  FROM metric_parts)"""

CTE["desc_map"] = f"""desc_map AS (
  SELECT code, arg_max(description, priority) AS description
  FROM (SELECT * FROM (VALUES {_INLINE}) t(code, description, priority)
        UNION ALL
        SELECT naics_code, naics_description, 3 FROM metrics WHERE NOT {generic_sql('naics_description')}) u
  WHERE code IS NOT NULL GROUP BY code)"""


_DEPS = {
    "cust_codes": [], "order_figs": [], "companies": ["cust_codes", "order_figs"],
    "scored": ["cust_codes", "order_figs"], "buildings": [], "filtered": ["scored", "companies"],
    "prepared": ["filtered"], "metrics": ["cust_codes", "served_revenue"], "served_revenue": ["cust_codes"], "desc_map": ["metrics"],
}


def with_ctes(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` the named carrier CTEs (dependencies first) and extra CTEs."""
    order: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


oracle("ranked_companies", with_ctes(["prepared"], "SELECT * FROM prepared"))

_RANKINGS_BODY = f"""SELECT m.naics_code,
       CASE WHEN {generic_sql('m.naics_description')}
            THEN coalesce(d4.description, dfull.description, {sector_sql('m.naics_code')})
            ELSE m.naics_description END AS naics_description,
       m.attractiveness_score,
       CAST(coalesce(c.company_count, 0) AS BIGINT) AS company_count,
       CAST(coalesce(c.customer_count, 0) AS BIGINT) AS customer_count,
       CAST(coalesce(c.company_count, 0) - coalesce(c.customer_count, 0) AS BIGINT) AS prospect_count,
       m.icp_fit_score, m.profitability_score, m.market_size_score, m.market_size_count,
       m.churn_health_score, m.ticket_health_score, m.icp_fit_reasoning AS reasoning
FROM metrics m
LEFT JOIN (SELECT naics_4digit AS naics_code, count(company_id) AS company_count,
                  sum(coalesce(CAST(is_customer AS INTEGER), 0)) AS customer_count
           FROM filtered WHERE naics_4digit IS NOT NULL GROUP BY naics_4digit) c ON m.naics_code = c.naics_code
LEFT JOIN desc_map d4 ON (CASE WHEN length(m.naics_code) >= 4 THEN substr(m.naics_code, 1, 4) END) = d4.code
LEFT JOIN desc_map dfull ON m.naics_code = dfull.code"""

CTE["rankings"] = "rankings AS (" + _RANKINGS_BODY + ")"
_DEPS["rankings"] = ["metrics", "desc_map", "filtered"]

oracle("industry_rankings", with_ctes(["rankings"], "SELECT * FROM rankings"))
oracle("industry_summary", with_ctes(["rankings"], """SELECT CAST(count(*) AS BIGINT) AS total_industries,
       max(attractiveness_score) AS top_score, CAST(coalesce(sum(company_count), 0) AS BIGINT) AS total_companies
FROM rankings"""))
oracle("industry_search_code", with_ctes(["rankings"], "SELECT * FROM rankings WHERE starts_with(naics_code, '62')"))


def _text_search_sql(query: str) -> str:
    terms = config.expand_search_query(query)
    conds = " OR ".join(f"coalesce(contains(lower({c}), '{t}'), false)" for c in ("naics_description", "reasoning")
                        for t in terms)
    return f"SELECT * FROM rankings WHERE {conds}"


oracle("industry_search_text", with_ctes(["rankings"], _text_search_sql("construction")))
oracle("facet_values", with_ctes(["filtered"], """SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'scoring_path' AS facet, CAST(scoring_path AS VARCHAR) AS value FROM filtered
  UNION ALL SELECT 'naics_4digit', CAST(naics_4digit AS VARCHAR) FROM filtered
  UNION ALL SELECT 'state', CAST(state AS VARCHAR) FROM filtered
  UNION ALL SELECT 'primary_naics', CAST(primary_naics AS VARCHAR) FROM filtered) s
WHERE value IS NOT NULL GROUP BY facet, value"""))

_VIEW_PRED = "scoring_path = 'prospect' AND final_score BETWEEN 30.0 AND 90.0"
oracle("ranked_view", with_ctes(["prepared"], f"""SELECT *, CAST(row_number() OVER (ORDER BY final_score DESC NULLS LAST,
       company_id ASC NULLS LAST) AS BIGINT) AS global_rank
FROM prepared WHERE {_VIEW_PRED}"""))
oracle("filtered_summary", with_ctes(["prepared"], f"""SELECT CAST(count(*) AS BIGINT) AS total_count,
       CAST(count_if({_VIEW_PRED}) AS BIGINT) AS filtered_count,
       round(avg(CASE WHEN {_VIEW_PRED} THEN final_score END), 4) AS avg_score,
       CAST(count_if({_VIEW_PRED} AND is_customer) AS BIGINT) AS customer_count,
       CAST(count_if({_VIEW_PRED} AND NOT is_customer) AS BIGINT) AS prospect_count
FROM prepared"""))


# ------------------------------------------------------------------ gates
CTE["valid_buildings"] = "valid_buildings AS (SELECT * FROM buildings WHERE company_id IN (SELECT company_id FROM companies))"
_DEPS["valid_buildings"] = ["buildings", "companies"]


def _gate(gate, kind, subject, value, threshold, passed, detail="CAST(NULL AS VARCHAR)") -> str:
    thr = "CAST(NULL AS DOUBLE)" if threshold is None else _d(threshold)
    return (f"SELECT '{gate}' AS gate, '{kind}' AS kind, '{subject}' AS subject, CAST({value} AS DOUBLE) AS value, "
            f"{thr} AS threshold, CAST({passed} AS BOOLEAN) AS passed, CAST({detail} AS VARCHAR) AS detail")


def _completeness_sql(table: str) -> str:
    parts = []
    for f in config.CRITICAL_FIELDS_NEW:
        v = f"(SELECT avg(CASE WHEN {f} IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {table})"
        parts.append(_gate("critical_field_completeness", "blocking", f, v, config.COMPLETENESS_MIN,
                           f"coalesce({v} >= {_d(config.COMPLETENESS_MIN)}, false)"))
    return "\nUNION ALL\n".join(parts)


def _sample_sql(ids_sql: str) -> str:
    return f"(SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM ({ids_sql}) x ORDER BY id LIMIT 5) y)"


def _dup_sql(table: str, key: str, subject: str) -> str:
    d = f"(SELECT {key} AS id, count(*) AS n FROM {table} GROUP BY {key} HAVING count(*) > 1)"
    rows = f"(SELECT coalesce(sum(n), 0) FROM {d} d)"
    keys = f"(SELECT count(*) FROM {d} d)"
    return _gate("no_duplicates", "blocking", subject, rows, 0.0, f"{rows} = 0",
                 f"CAST({keys} AS VARCHAR) || ' ids; sample: ' || coalesce({_sample_sql(f'SELECT CAST(id AS VARCHAR) AS id FROM {d} d')}, '')")


def _integrity_sql(table: str, subject: str) -> str:
    ids = f"SELECT DISTINCT company_id AS id FROM {table} WHERE company_id NOT IN (SELECT company_id FROM companies)"
    keys = f"(SELECT count(*) FROM ({ids}) m)"
    return _gate("join_integrity", "blocking", subject, keys, 0.0, f"{keys} = 0",
                 f"'sample: ' || coalesce({_sample_sql(ids)}, '')")


_COORD = _gate("coordinate_coverage", "non_blocking", "buildings",
               "(SELECT coalesce(avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) FROM valid_buildings)",
               config.COORD_COVERAGE_MIN,
               f"(SELECT coalesce(avg(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0) FROM valid_buildings) >= {_d(config.COORD_COVERAGE_MIN)}")
_RV = "(SELECT CASE WHEN count(*) > 0 THEN CAST(count_if(has_research_doc) AS DOUBLE) / count(*) ELSE 0.0 END FROM filtered)"
_RESEARCH = _gate("research_coverage", "non_blocking", "scored", _RV, config.RESEARCH_COVERAGE_MIN,
                  f"{_RV} >= {_d(config.RESEARCH_COVERAGE_MIN)}")
_WV = "(SELECT round(sum(w), 9) FROM (VALUES " + ", ".join(f"({_d(w)})" for w in config.NAICS_WEIGHTS.values()) + ") t(w))"
_WEIGHTS = _gate("scoring_weights", "non_blocking", "weights", _WV, 1.0,
                 f"coalesce(abs({_WV} - 1.0) <= {_d(config.WEIGHT_SUM_TOLERANCE)}, false)")
_ER_NONE = _gate("entity_resolution", "non_blocking", "entity_resolution_log", "0.0", config.ER_ORPHAN_MAX, "true", "'no log'")

oracle("gate_completeness", with_ctes(["filtered"], _completeness_sql("filtered")))
oracle("gate_duplicates", with_ctes(["filtered", "valid_buildings"],
                                    _dup_sql("filtered", "company_id", "scored.company_id") + "\nUNION ALL\n"
                                    + _dup_sql("valid_buildings", "building_id", "buildings.building_id")))
oracle("gate_join_integrity", with_ctes(["scored", "companies", "buildings"],
                                        _integrity_sql("scored", "scored->companies") + "\nUNION ALL\n"
                                        + _integrity_sql("buildings", "buildings->companies")))
oracle("gate_coverage", with_ctes(["filtered", "valid_buildings"], _COORD + "\nUNION ALL\n" + _RESEARCH))
oracle("rank_contiguity", with_ctes(["filtered"], """SELECT primary_naics, min(rank) AS min_rank, max(rank) AS max_rank,
       CAST(count(DISTINCT rank) AS BIGINT) AS distinct_ranks, CAST(count_if(rank IS NULL) AS BIGINT) AS null_ranks
FROM filtered GROUP BY primary_naics
HAVING NOT coalesce(min(rank) = 1 AND max(rank) = count(DISTINCT rank) AND count_if(rank IS NULL) = 0, false)"""))
oracle("rank_order", with_ctes(["filtered"], """SELECT * FROM (
  SELECT primary_naics, company_id, final_score, rank,
         CAST(row_number() OVER (PARTITION BY primary_naics ORDER BY final_score DESC NULLS LAST,
              rank ASC NULLS LAST, company_id ASC NULLS LAST) AS BIGINT) AS expected_rank
  FROM filtered) t WHERE rank IS DISTINCT FROM expected_rank"""))
oracle("valid_buildings", with_ctes(["valid_buildings"], "SELECT * FROM valid_buildings"))
oracle("orphan_report", with_ctes(["scored", "companies", "buildings"], """
SELECT 'scored' AS table_name, CAST(count(*) AS BIGINT) AS orphan_rows, CAST(count(DISTINCT company_id) AS BIGINT) AS orphan_keys
FROM scored WHERE company_id NOT IN (SELECT company_id FROM companies)
UNION ALL
SELECT 'buildings', CAST(count(*) AS BIGINT), CAST(count(DISTINCT company_id) AS BIGINT)
FROM buildings WHERE company_id NOT IN (SELECT company_id FROM companies)"""))


# ------------------------------------------------------------- enrichment
def d1_sql(c: str) -> str:
    base = f"regexp_replace(replace(replace(replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), 'http://', ''), 'https://', ''), 'www.', ''), '/+$', '')"
    return f"nullif(split_part({base}, '/', 1), '')"


def d2_sql(c: str) -> str:
    return f"nullif(regexp_replace(replace(replace(replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), 'http://', ''), 'https://', ''), 'www.', ''), '/+$', ''), '')"


CTE["crm"] = """crm AS (
  SELECT DISTINCT 'https://www.' || lower(replace(c.c_name, '#', '')) || '.example.com'
         || CASE WHEN o.o_orderpriority = '1-URGENT' THEN '/' ELSE '/contact' END AS domain
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH'))"""
CTE["crm_flag"] = f"""crm_flag AS (
  SELECT company_id, bool_or(coalesce({d1_sql('website')} IN (SELECT {d2_sql('domain')} FROM crm WHERE {d2_sql('domain')} IS NOT NULL), false)) AS hit
  FROM companies GROUP BY company_id)"""
CTE["penetration"] = """penetration AS (
  SELECT c.company_id, CAST(c.building_count_estimate AS INTEGER) AS total_buildings_estimate,
         CAST(coalesce(s.served, 0) AS INTEGER) AS served_buildings,
         CAST(coalesce(s.served, 0) AS DOUBLE) / CAST(c.building_count_estimate AS DOUBLE) * 100.0 AS penetration_rate,
         CASE WHEN coalesce(s.served, 0) > 0 THEN 'estimated' ELSE 'none' END AS data_quality
  FROM companies c
  LEFT JOIN (SELECT company_id, count(*) AS served FROM valid_buildings WHERE is_served GROUP BY company_id) s
    ON c.company_id = s.company_id)"""
_DEPS.update({"crm": [], "crm_flag": ["crm", "companies"], "penetration": ["companies", "valid_buildings"]})

_RAW = "c.building_count_estimate, c.growing_business_code, c.contacts_count"
oracle("raw_field_enrichment", with_ctes(["filtered"], f"""SELECT f.*, {_RAW}
FROM filtered f LEFT JOIN companies c ON f.company_id = c.company_id"""))
oracle("crm_presence", with_ctes(["filtered", "crm_flag"], """SELECT f.company_id, coalesce(k.hit, false) AS in_hubspot
FROM filtered f LEFT JOIN crm_flag k ON f.company_id = k.company_id"""))
oracle("penetration_estimates", with_ctes(["penetration"], "SELECT * FROM penetration"))
oracle("building_penetration", with_ctes(["companies", "valid_buildings"], """SELECT c.company_id,
       coalesce(b.total, 0) AS total_buildings, coalesce(b.served, 0) AS served_buildings,
       CASE WHEN b.total > 0 THEN CAST(b.served AS DOUBLE) / CAST(b.total AS DOUBLE) * 100.0 ELSE 0.0 END AS penetration_rate
FROM (SELECT DISTINCT company_id FROM companies) c
LEFT JOIN (SELECT company_id, CAST(count(*) AS BIGINT) AS total, CAST(count_if(is_served) AS BIGINT) AS served
           FROM valid_buildings GROUP BY company_id) b ON c.company_id = b.company_id"""))
oracle("penetration_lookup", with_ctes(["filtered", "penetration"], """SELECT f.company_id, p.penetration_rate,
       CASE WHEN p.penetration_rate IS NOT NULL THEN printf('%.1f%%', p.penetration_rate) ELSE '—' END AS penetration_display
FROM filtered f LEFT JOIN penetration p ON f.company_id = p.company_id"""))


def _even1(x: str) -> str:
    """One decimal, ties to the even digit, from whole millionths."""
    m = f"CAST(round({x} * 1000000) AS BIGINT)"
    return (f"CAST(CASE WHEN {m} % 100000 = 50000 AND ({m} // 100000) % 2 = 0 THEN {m} // 100000 "
            f"ELSE ({m} + 50000) // 100000 END AS DOUBLE) / CAST(10 AS DOUBLE)")


_GROWTH = "CASE upper(trim(growing_business_code)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in config.GROWTH_LABELS.items()) + " ELSE upper(trim(growing_business_code)) END"
oracle("ranked_table", with_ctes(["prepared", "crm_flag"], f"""SELECT company_id,
       CAST(row_number() OVER (ORDER BY final_score DESC NULLS LAST, company_id ASC NULLS LAST) AS BIGINT) AS rank,
       company_name AS company, scoring_path AS path,
       CASE WHEN naics_4digit IS NULL THEN '—' WHEN TRY_CAST(naics_4digit AS DOUBLE) IS NOT NULL
            THEN CAST(CAST(trunc(TRY_CAST(naics_4digit AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE naics_4digit END AS naics,
       {_even1('final_score')} AS final_score, {_even1('company_opportunity_score')} AS company_score,
       CASE WHEN city IS NOT NULL AND state IS NOT NULL THEN city || ', ' || state ELSE '—' END AS location,
       CASE WHEN coalesce(in_hubspot, false) THEN '✅' ELSE '' END AS in_hubspot,
       CASE WHEN icp_fit_score IS NULL THEN '—' ELSE CAST(CAST(trunc(icp_fit_score) AS BIGINT) AS VARCHAR) END AS icp_fit,
       CAST(coalesce(building_count_estimate, 0) AS BIGINT) AS buildings,
       CASE WHEN growing_business_code IS NULL THEN '—' ELSE {_GROWTH} END AS growth,
       CAST(coalesce(contacts_count, 0) AS BIGINT) AS contacts,
       {_even1('naics_attractiveness_score')} AS naics_score,
       0 AS employees, '—' AS revenue_m
FROM (SELECT p.*, {_RAW}, coalesce(k.hit, false) AS in_hubspot
      FROM prepared p LEFT JOIN companies c ON p.company_id = c.company_id
      LEFT JOIN crm_flag k ON p.company_id = k.company_id) e
WHERE final_score BETWEEN 0.0 AND 100.0"""))


# ------------------------------------------------------------------ export
CTE["research"] = """research AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS company_id, coalesce(c.c_name, 'Unknown Company') AS company_name,
         l.quality = 1 AS had_web_research,
         least(CAST(100 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / CAST(200 AS DOUBLE)) AS icp_fit_score,
         CASE WHEN l.toxic = 1 THEN 'low' WHEN l.quality = 1 THEN 'high' ELSE 'medium' END AS confidence,
         d.text AS reasoning,
         CASE d.lang WHEN 'en' THEN 'pursue' WHEN 'fr' THEN 'nurture' END AS recommendation,
         d.source AS timing,
         CAST(to_json(string_split(d.text, chr(10))) AS VARCHAR) AS hot_lead_signals,
         CASE WHEN d.lang = 'de' THEN d.text
              WHEN d.lang = 'fr' THEN '"' || d.source || '"'
              WHEN d.lang = 'es' THEN '[' || CAST(d.n_chars AS VARCHAR) || ',' || CAST(d.doc_id AS VARCHAR) || ']'
              ELSE CAST(to_json([d.source, d.lang]) AS VARCHAR) END AS concerns,
         CAST(to_json({'news_findings': CASE WHEN d.lang <> 'de' THEN {
                          'found_recent_news': l.quality = 1, 'headline': 'Update from ' || d.source,
                          'date': d.lang, 'signal_type': CASE WHEN l.toxic = 1 THEN 'risk' ELSE 'growth' END,
                          'summary': 'Document of ' || CAST(d.n_chars AS VARCHAR) || ' characters'} END,
                       'jobs_findings': {'found_ops_roles': d.n_chars > 5000,
                          'hiring_scale': CASE WHEN d.n_chars > 10000 THEN 'large' ELSE 'small' END,
                          'role_examples': string_split(d.text, chr(10)), 'summary': d.source},
                       'corporate_ops_findings': {'has_vendor_portal': d.lang = 'en', 'has_facilities_dept': l.toxic = 0,
                          'centralized_operations': l.quality = 0, 'professionalism_level': d.lang,
                          'summary': d.source}}) AS VARCHAR) AS research_summary
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN customer c ON d.doc_id = c.c_custkey)"""
CTE["merged"] = f"""merged AS (
  SELECT p.*, coalesce(k.hit, false) AS in_hubspot,
         r.had_web_research, r.confidence, r.reasoning, r.hot_lead_signals, r.concerns, r.recommendation,
         r.timing, r.research_summary,
         c.website, c.building_count_estimate, c.growing_business_code, c.contacts_count
  FROM prepared p
  LEFT JOIN crm_flag k ON p.company_id = k.company_id
  LEFT JOIN research r ON p.company_id = r.company_id
  LEFT JOIN companies c ON p.company_id = c.company_id
  WHERE {_VIEW_PRED})"""
_DEPS.update({"research": [], "merged": ["prepared", "crm_flag", "research", "companies"]})


def _allstr(s):
    return f"coalesce(list_bool_and(list_transform(json_extract({s}, '$[*]'), lambda x: json_type(x) = 'VARCHAR')), true)"


def d3_count_sql(s: str) -> str:
    return (f"CAST(CASE WHEN {s} IS NULL OR {s} = '' THEN 0 WHEN NOT json_valid({s}) THEN 0 "
            f"WHEN json_type({s}) = 'ARRAY' AND {_allstr(s)} THEN json_array_length({s}) ELSE 0 END AS INTEGER)")


def d3_text_sql(s: str) -> str:
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN '' WHEN NOT json_valid({s}) THEN {s} "
            f"WHEN json_type({s}) = 'ARRAY' AND {_allstr(s)} THEN array_to_string(json_extract_string({s}, '$[*]'), chr(10)) "
            f"WHEN json_type({s}) = 'ARRAY' THEN {s} "
            f"WHEN json_type({s}) = 'VARCHAR' THEN json_extract_string({s}, '$') "
            f"WHEN json_type({s}) = 'BOOLEAN' THEN CASE WHEN json_extract_string({s}, '$') = 'true' THEN 'True' ELSE 'False' END "
            f"WHEN json_type({s}) = 'NULL' THEN 'None' ELSE CAST(json({s}) AS VARCHAR) END")


def d6_sql(r: str) -> str:
    return (f"CASE WHEN {r} IS NULL THEN '' WHEN length({r}) > {config.REASONING_MAX_CHARS} "
            f"THEN substr({r}, 1, {config.REASONING_MAX_CHARS}) || '...' ELSE {r} END")


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sheet1_sql() -> str:
    from .export import SHEET1_NAMES, SHEET1_ORDER
    present = {"company_id", "company_name", "primary_naics", "naics_4digit", "city", "state", "scoring_path",
               "is_customer", "in_hubspot", "final_score", "naics_attractiveness_score", "company_opportunity_score",
               "icp_fit_score", "building_count_estimate", "growing_business_code", "contacts_count", "website",
               "recommendation", "confidence", "timing", "rank", "has_research_doc"}
    special = {"icp_reasoning_short": d6_sql("reasoning"), "signals_count": d3_count_sql("hot_lead_signals"),
               "concerns_count": d3_count_sql("concerns")}
    cols = []
    for c in SHEET1_ORDER:
        if c in special:
            cols.append(f"{special[c]} AS {_q(SHEET1_NAMES[c])}")
        elif c in present:
            cols.append(f"{c} AS {_q(SHEET1_NAMES[c])}")
    return "SELECT " + ",\n       ".join(cols) + "\nFROM merged"


def _sheet2_sql() -> str:
    from .export import SHEET2_NAMES
    exprs = [("company_id", "company_id"), ("company_name", "company_name"), ("icp_fit_score", "icp_fit_score"),
             ("recommendation", "recommendation"), ("confidence", "confidence"), ("reasoning", "reasoning"),
             ("hot_lead_signals_expanded", d3_text_sql("hot_lead_signals")),
             ("concerns_expanded", d3_text_sql("concerns")), ("timing", "timing")]
    return "SELECT " + ",\n       ".join(f"{e} AS {_q(SHEET2_NAMES[c])}" for c, e in exprs) + "\nFROM merged"


def _d4_sql(s: str) -> list[tuple[str, str]]:
    def b(path):
        v = f"json_extract_string({s}, '{path}')"
        return f"coalesce(CASE {v} WHEN 'true' THEN true WHEN 'false' THEN false END, false)"

    def t(path):
        return f"coalesce(json_extract_string({s}, '{path}'), '')"

    roles = (f"coalesce(array_to_string(list_slice(json_extract_string({s}, '$.jobs_findings.role_examples[*]'), 1, "
             f"{config.ROLE_EXAMPLES_MAX}), chr(10)), '')")
    return [("news_found", b("$.news_findings.found_recent_news")), ("news_headline", t("$.news_findings.headline")),
            ("news_date", t("$.news_findings.date")), ("news_signal_type", t("$.news_findings.signal_type")),
            ("news_summary", t("$.news_findings.summary")),
            ("jobs_found_ops_roles", b("$.jobs_findings.found_ops_roles")),
            ("jobs_hiring_scale", t("$.jobs_findings.hiring_scale")), ("jobs_role_examples", roles),
            ("corp_has_vendor_portal", b("$.corporate_ops_findings.has_vendor_portal")),
            ("corp_has_facilities_dept", b("$.corporate_ops_findings.has_facilities_dept")),
            ("corp_centralized_operations", b("$.corporate_ops_findings.centralized_operations")),
            ("corp_professionalism_level", t("$.corporate_ops_findings.professionalism_level")),
            ("corp_summary", t("$.corporate_ops_findings.summary"))]


def _sheet3_sql() -> str:
    from .export import SHEET3_NAMES
    exprs = [("company_id", "company_id"), ("company_name", "company_name"), ("had_web_research", "had_web_research")]
    exprs += _d4_sql("research_summary")
    return ("SELECT " + ",\n       ".join(f"{e} AS {_q(SHEET3_NAMES[c])}" for c, e in exprs)
            + "\nFROM merged WHERE had_web_research = true")


oracle("export_rankings", with_ctes(["merged"], _sheet1_sql()))
oracle("export_reasoning", with_ctes(["merged"], _sheet2_sql()))
oracle("export_research", with_ctes(["merged"], _sheet3_sql()))
oracle("export_manifest", with_ctes(["merged"], """SELECT * FROM (VALUES
  ('Export Timestamp', '2026-01-01 00:00:00'),
  ('Total Companies Exported', (SELECT CAST(count(*) AS VARCHAR) FROM merged)),
  ('Filter: Customer Status', 'prospect'), ('Filter: NAICS Code', 'All'), ('Filter: HubSpot Status', 'All'),
  ('Filter: State', 'All'), ('Filter: Score Range (Min)', '30.0'), ('Filter: Score Range (Max)', '90.0')) t("Property", "Value")"""))


# -------------------------------------------------------------- geo, docs
def reason_sql(lat: str, lon: str) -> str:
    return (f"CASE WHEN {lat} IS NULL OR {lon} IS NULL OR isnan({lat}) OR isnan({lon}) THEN 'Coordinates missing' "
            f"WHEN NOT ({lat} BETWEEN -90.0 AND 90.0) THEN 'Latitude out of range: ' || CAST({lat} AS VARCHAR) "
            f"WHEN NOT ({lon} BETWEEN -180.0 AND 180.0) THEN 'Longitude out of range: ' || CAST({lon} AS VARCHAR) END")


CTE["hq"] = """hq AS (
  SELECT f.*, c.hq_latitude AS latitude, c.hq_longitude AS longitude
  FROM filtered f LEFT JOIN companies c ON f.company_id = c.company_id)"""
_DEPS["hq"] = ["filtered", "companies"]

oracle("coordinate_validation", with_ctes(["valid_buildings"], f"""SELECT building_id, source,
       {reason_sql('latitude', 'longitude')} AS coord_reason FROM valid_buildings"""))
oracle("exclusion_summary", with_ctes(["valid_buildings"], f"""SELECT
       CAST(count_if(r IS NOT NULL) AS BIGINT) AS total_excluded,
       CAST(count_if(r IS NOT NULL AND source = 'dataaxle') AS BIGINT) AS dataaxle_excluded,
       CAST(count_if(r IS NOT NULL AND source = 'manual') AS BIGINT) AS manual_excluded
FROM (SELECT source, {reason_sql('latitude', 'longitude')} AS r FROM valid_buildings) t"""))
oracle("map_statistics", with_ctes(["hq"], f"""SELECT CAST(count(*) AS BIGINT) AS total_companies,
       CAST(count_if(r IS NULL) AS BIGINT) AS valid_companies, CAST(count_if(r IS NOT NULL) AS BIGINT) AS excluded_companies,
       CAST(count_if(r IS NULL AND is_customer) AS BIGINT) AS customers,
       CAST(count_if(r IS NULL) - count_if(r IS NULL AND is_customer) AS BIGINT) AS prospects
FROM (SELECT *, {reason_sql('latitude', 'longitude')} AS r FROM hq) t"""))
oracle("marker_colors", with_ctes(["hq"], f"""SELECT company_id,
       CASE WHEN coalesce(is_customer, false) THEN 'green' ELSE 'red' END AS color_customer_status,
       CASE WHEN coalesce(has_research_doc, false) THEN 'blue' ELSE 'gray' END AS color_research_status,
       CASE WHEN coalesce(final_score, 0.0) >= 80 THEN 'green' WHEN coalesce(final_score, 0.0) >= 60 THEN 'gold'
            WHEN coalesce(final_score, 0.0) >= 40 THEN 'orange' ELSE 'red' END AS color_score_tier
FROM hq WHERE ({reason_sql('latitude', 'longitude')}) IS NULL"""))

_WS_SQL = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_WS_SQL}'), lambda w: w <> '')"


CTE["rdocs"] = """rdocs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS company_id, c.c_name AS company_name, d.text AS research_document,
         CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'pending' END AS status,
         CAST(trunc(d.n_chars / 6) AS INTEGER) AS stat_word_count, l.toxic AS urgent_flags, l.quality AS action_flags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN customer c ON d.doc_id = c.c_custkey)"""
_DEPS["rdocs"] = []


def count_sql(t: str, marker: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{marker}')) AS INTEGER)"


oracle("document_flags", with_ctes(["rdocs"], f"""SELECT company_id,
       CAST(len({words_sql('research_document')}) AS INTEGER) AS word_count,
       {count_sql('research_document', 'URGENT')} AS urgent_flags, {count_sql('research_document', 'ACTION')} AS action_flags,
       len({words_sql('research_document')}) > 0 AS has_content,
       {count_sql('research_document', 'WITH')} AS with_flags, {count_sql('research_document', 'THAT')} AS that_flags,
       coalesce(company_name, 'Unknown Company') AS company_name
FROM rdocs"""))

_NOTICE = " || ".join(["chr(10)", "chr(10)", "'...'", "chr(10)", "chr(10)",
                       "'*(Document truncated for display. Full content available.)*'"])
_HL = (r"regexp_replace(regexp_replace(research_document, '\*\*URGENT:\*\*', '🚨 **URGENT:**', 'g'), "
       r"'\*\*ACTION:\*\*', '✅ **ACTION:**', 'g')")
oracle("document_display", with_ctes(["rdocs"], f"""SELECT company_id,
       CASE WHEN len({words_sql('h')}) > {config.DOCUMENT_MAX_WORDS}
            THEN array_to_string(list_slice({words_sql('h')}, 1, {config.DOCUMENT_MAX_WORDS}), ' ') || {_NOTICE}
            ELSE h END AS display_text,
       coalesce(len({words_sql('h')}) > {config.DOCUMENT_MAX_WORDS}, false) AS was_truncated
FROM (SELECT company_id, {_HL} AS h FROM rdocs) t"""))

_Q = "''"   # a quote inside an SQL string literal
_REASON = (
    f"CASE WHEN research_document IS NULL THEN 'Missing {_Q}research_document{_Q} field' "
    f"WHEN status IS NULL THEN 'Missing {_Q}status{_Q} field' "
    f"WHEN status <> 'completed' THEN 'Status is {_Q}' || status || '{_Q}, expected {_Q}completed{_Q}' "
    f"WHEN length(research_document) < {config.DOC_MIN_CHARS} THEN 'Document too short: ' "
    f"|| CAST(length(research_document) AS VARCHAR) || ' chars (minimum {config.DOC_MIN_CHARS})' "
    f"WHEN stat_word_count < {config.DOC_MIN_WORDS} THEN 'Word count too low: ' "
    f"|| CAST(stat_word_count AS VARCHAR) || ' (minimum {config.DOC_MIN_WORDS})' END")
oracle("document_validity", with_ctes(["rdocs"], f"SELECT company_id, ({_REASON}) IS NULL AS is_valid, "
                                                  f"{_REASON} AS reason FROM rdocs"))
oracle("flag_count_mismatch", with_ctes(["rdocs"], f"""SELECT * FROM (
  SELECT company_id, urgent_flags, action_flags, {count_sql('research_document', 'URGENT')} AS urgent_in_text,
         {count_sql('research_document', 'ACTION')} AS action_in_text FROM rdocs) t
WHERE urgent_flags <> urgent_in_text OR action_flags <> action_in_text"""))


# ------------------------------------------------------------------ scoring
def _log_scale_sql(x: str, cap: float) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE least({_d(100)}, greatest({_d(0)}, "
            f"{_d(100)} * ln(1 + greatest(CAST({x} AS DOUBLE), {_d(0)})) / {_d(__import__('math').log1p(cap))})) END")


def _wsum_sql(parts) -> str:
    n = _d(config.NEUTRAL_COMPONENT)
    return " + ".join(f"{_d(w)} * coalesce({c}, {n})" for w, c in parts)


_P = config.PROSPECT_WEIGHTS
_C = config.CUSTOMER_WEIGHTS
_B = anchored_sql("building_count_estimate", config.COMPANY_BUILDINGS_ANCHORS)
_R = anchored_sql("sales_volume", config.COMPANY_REVENUE_ANCHORS)
_E = _log_scale_sql("c_employees", config.COMPANY_EMPLOYEES_FULL)
_X = _log_scale_sql("(CAST(CASE WHEN building_count_estimate IS NOT NULL THEN greatest(building_count_estimate - coalesce(served, 0), 0) END AS DOUBLE) * (CAST(served_cents AS DOUBLE) / served / 100.0))", 5_000_000.0)
_PROFIT = f"least({_d(100)}, greatest({_d(0)}, margin / {_d(config.PROFIT_MARGIN_FULL)} * {_d(100)}))"
_CT = (f"CASE WHEN coalesce(contacts_count, 0) > 0 THEN {_d(config.CONTACT_SCORE_HAS)} "
       f"ELSE {_d(config.CONTACT_SCORE_NONE)} END")
oracle("company_scoring", with_ctes(["filtered", "served_revenue", "order_figs"], f"""SELECT company_id, scoring_path,
       round(b, 4) AS buildings_score, round(r, 4) AS revenue_score, round(e, 4) AS employee_score, ct AS contact_score,
       round(x, 4) AS expansion_score, round(ch, 4) AS churn_score, round(pr, 4) AS profitability_score, round(tk, 4) AS tickets_score,
       round(comp, 4) AS company_opportunity_score,
       round(CASE WHEN is_customer = true THEN comp
                  ELSE {_d(config.FINAL_NAICS_WEIGHT)} * naics_attractiveness_score + {_d(config.FINAL_COMPANY_WEIGHT)} * comp END, 4) AS final_score
FROM (SELECT *, CASE WHEN is_customer = true
                     THEN {_wsum_sql([(_C['expansion'], 'x'), (_C['churn'], 'ch'), (_C['profitability'], 'pr'), (_C['tickets'], 'tk')])}
                     ELSE {_wsum_sql([(_P['icp_fit'], 'icp_fit_score'), (_P['buildings'], 'b'), (_P['revenue'], 'r'), (_P['employees'], 'e'), (_P['contacts'], 'ct')])}
                END AS comp
      FROM (SELECT f.*, {_B} AS b, {_R} AS r, {_E} AS e, {_CT} AS ct, {_X} AS x, {_PROFIT} AS pr
            FROM (SELECT f.*, c.building_count_estimate, c.sales_volume, c.employees AS c_employees, c.contacts_count,
                         v.served, v.served_cents, g.margin,
                         {_d(100)} - {_d(100)} * ({_d(1)} - CAST(o.n_finished AS DOUBLE) / o.n_orders) AS ch,
                         {_d(100)} - {_d(100)} * o.n_urgent / o.n_orders AS tk
                  FROM filtered f LEFT JOIN companies c ON f.company_id = c.company_id
                  LEFT JOIN (SELECT company_id, count(*) AS served, sum(revenue_cents) AS served_cents FROM served_revenue GROUP BY 1) v
                    ON v.company_id = f.company_id
                  LEFT JOIN order_figs o ON CAST(o.c_custkey AS VARCHAR) = f.company_id
                  LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS company_id, sum(disc_pct) / CAST(sum(n_lines) AS DOUBLE) / 100.0 AS margin
                             FROM (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pct
                                   FROM lineitem GROUP BY l_orderkey) l JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) g
                    ON g.company_id = f.company_id) f) x) y"""))
oracle("industry_revenue_medians", with_ctes(["served_revenue"], """SELECT naics_4digit, CAST(count(*) AS BIGINT) AS n_values,
       median(revenue_cents) AS median_cents FROM served_revenue GROUP BY naics_4digit"""))
oracle("naics_metrics", with_ctes(["metrics"], "SELECT * FROM metrics"))

_TARGETS = ", ".join(f"('{c}', {n})" for c, n in config.NAICS_TARGETS)
oracle("industry_caps", with_ctes(["filtered"], f"""SELECT company_id, naics_4digit, max_companies, building_count_estimate
FROM (SELECT f.company_id, f.naics_4digit, t.max_companies, c.building_count_estimate,
             row_number() OVER (PARTITION BY f.naics_4digit ORDER BY c.building_count_estimate DESC NULLS LAST,
                                f.company_id ASC) AS pos
      FROM filtered f LEFT JOIN companies c ON f.company_id = c.company_id
      JOIN (VALUES {_TARGETS}) t(naics_4digit, max_companies) ON f.naics_4digit = t.naics_4digit
      WHERE c.building_count_estimate - 1 > 0) x
WHERE pos <= max_companies"""))

_CH_ROWS = [(code, ch) for ch, spec in config.CHANNELS.items() for code in spec["naics_codes"]]
_CH_CASE = "CASE " + " ".join(f"WHEN starts_with(primary_naics, '{code}') THEN '{ch}'"
                              for code, ch in sorted(_CH_ROWS, key=lambda r: -len(r[0]))) + \
           f" ELSE '{config.DEFAULT_CHANNEL}' END"


def _ov(comp: str) -> str:
    whens = " ".join(f"WHEN '{ch}' THEN {_d(spec['score_weights_override'][comp])}"
                     for ch, spec in config.CHANNELS.items() if comp in (spec.get("score_weights_override") or {}))
    return f"CASE channel_id {whens} END"


oracle("channel_assignment", with_ctes(["scored"], f"""SELECT channel_id, company_id, primary_naics,
       {_ov('hygiene_relevance')} AS hygiene_relevance, {_ov('geographic_fit')} AS geographic_fit,
       {_ov('decision_maker_clarity')} AS decision_maker_clarity
FROM (SELECT company_id, primary_naics, {_CH_CASE} AS channel_id FROM scored) s"""))

_SQFT = ", ".join("('{}', '{}', {}, {}, {})".format(c, r, lo, "NULL" if hi is None else hi, "true" if inc else "false")
                  for c, r, lo, hi, inc in config.SQFT_CODES)
oracle("sqft_filter", with_ctes(["valid_buildings"], f"""SELECT b.building_id, b.square_footage_code, q.sqft_range,
       CAST(q.sqft_min AS INTEGER) AS sqft_min, CAST(q.sqft_max AS INTEGER) AS sqft_max, q.sqft_include IS NULL AS sqft_unknown
FROM valid_buildings b
LEFT JOIN (VALUES {_SQFT}) q(square_footage_code, sqft_range, sqft_min, sqft_max, sqft_include)
  ON b.square_footage_code = q.square_footage_code
WHERE coalesce(q.sqft_include, true)"""))
oracle("research_eligibility", with_ctes(["companies"], """SELECT company_id,
       coalesce(building_count_estimate, 0) >= 5
       AND (coalesce(sales_volume, 0.0) >= 10000000.0 OR coalesce(employees, 0) >= 100) AS eligible
FROM companies"""))


# ------------------------------------------------- contacts, churn, profile
CTE["contacts"] = """contacts AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS company_id, 'Buyer ' || o.o_orderpriority AS contact_name,
         lower(regexp_replace(o.o_orderpriority, '[^A-Za-z]', '', 'g')) || '@' || lower(replace(c.c_name, '#', ''))
           || '.example.com' AS contact_email,
         strftime(o.o_orderdate, '%Y-%m-%d') AS contact_date
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""
CTE["csum"] = """csum AS (
  SELECT company_id, CAST(count(*) AS INTEGER) AS contact_count, max(contact_date) AS last_contact_date,
         array_to_string(list_sort(list_distinct(list(contact_name))), '; ') AS contact_names,
         array_to_string(list_sort(list_distinct(list(contact_email))), '; ') AS contact_emails
  FROM contacts GROUP BY company_id)"""
CTE["churn"] = """churn AS (
  SELECT CAST(c_custkey AS VARCHAR) AS company_id, 1.0 - CAST(n_finished AS DOUBLE) / n_orders AS churn_probability,
         CASE WHEN 1.0 - CAST(n_finished AS DOUBLE) / n_orders >= 0.7 THEN 'High'
              WHEN 1.0 - CAST(n_finished AS DOUBLE) / n_orders >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_tier,
         '2024-06-30' AS prediction_date,
         CAST(100 AS DOUBLE) - CAST(100 AS DOUBLE) * n_urgent / n_orders AS ticket_health
  FROM order_figs)"""
_DEPS.update({"contacts": [], "csum": ["contacts"], "churn": ["order_figs"]})

oracle("contact_summary", with_ctes(["csum"], "SELECT * FROM csum"))
oracle("interaction_counts", """SELECT CAST(user_id AS VARCHAR) AS company_id, event_type AS engagement_type,
       CAST(count(*) AS BIGINT) AS n_engagements
FROM events GROUP BY user_id, event_type""")
oracle("naics_risk_metrics", with_ctes(["filtered", "churn"], """SELECT f.naics_4digit, CAST(count(*) AS BIGINT) AS n_companies,
       round(avg(ch.churn_probability), 6) AS avg_churn, round(avg(ch.ticket_health), 6) AS avg_ticket
FROM filtered f JOIN churn ch ON f.company_id = ch.company_id GROUP BY f.naics_4digit"""))


def strip0_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(nullif(ltrim(trim(CAST({x} AS VARCHAR)), '0'), ''), '0') END"


def initcap_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')")


_RISK = ("CASE risk_tier " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''"))
    for k, v in __import__("canvass.functions.formatting", fromlist=["RISK_MESSAGES"]).RISK_MESSAGES.items())
    + " ELSE 'Risk Tier: ' || coalesce(risk_tier, 'None') END")
_PC = "c.primary_contact"
oracle("company_profile", with_ctes(["prepared", "valid_buildings", "csum", "churn", "research"], f"""SELECT
  c.company_id, coalesce(c.name, 'N/A') AS name, coalesce(c.primary_naics, 'N/A') AS naics,
  CASE WHEN c.hq_latitude IS NOT NULL AND c.hq_longitude IS NOT NULL
       THEN printf('%.4f, %.4f', c.hq_latitude, c.hq_longitude) ELSE 'N/A' END AS hq_coordinates,
  coalesce(c.city, 'N/A') AS hq_city, coalesce(c.state, 'N/A') AS hq_state, CAST(coalesce(c.building_count, 0) AS VARCHAR) AS buildings,
  coalesce(CAST(CAST(coalesce(c.building_count_estimate, c.building_count) AS BIGINT) AS VARCHAR), 'N/A') AS building_count_estimate,
  coalesce(CAST(CAST(trunc(CAST(c.employees AS DOUBLE)) AS BIGINT) AS VARCHAR), 'N/A') AS employee_size,
  CASE WHEN c.sales_volume IS NULL THEN 'N/A' ELSE '$' || format('{{:,.0f}}', c.sales_volume) END AS sales_volume,
  nullif(trim(concat_ws(' ', json_extract_string({_PC}, '$.first_name'), json_extract_string({_PC}, '$.last_name'))), '') AS contact_name,
  CASE WHEN len(json_extract_string({_PC}, '$.job_titles[*]')) > 0
       THEN array_to_string(json_extract_string({_PC}, '$.job_titles[*]'), ', ') END AS contact_titles,
  {initcap_sql(f"replace(json_extract_string({_PC}, '$.management_level'), '_', ' ')")} AS contact_level,
  json_extract_string({_PC}, '$.gender') AS contact_gender,
  CAST(coalesce(b.total, 0) AS BIGINT) AS total_buildings, CAST(coalesce(b.served, 0) AS BIGINT) AS served_buildings,
  CASE WHEN coalesce(b.total, 0) > 0 THEN CAST(b.served AS DOUBLE) / CAST(b.total AS DOUBLE) * 100.0 ELSE 0.0 END AS penetration_rate,
  CAST(coalesce(k.contact_count, 0) AS INTEGER) AS contact_count, coalesce(k.last_contact_date, 'N/A') AS last_contact,
  ch.churn_probability, ch.risk_tier, CASE WHEN ch.risk_tier IS NOT NULL THEN {_RISK.replace('risk_tier', 'ch.risk_tier')} END AS risk_message,
  CASE WHEN trim(r.recommendation) <> '' THEN r.recommendation ELSE 'N/A' END AS recommendation,
  CASE WHEN trim(r.confidence) <> '' THEN r.confidence ELSE 'N/A' END AS confidence,
  CASE WHEN trim(r.reasoning) <> '' THEN r.reasoning ELSE 'N/A' END AS reasoning,
  coalesce(p.scoring_path, 'Prospect') AS scoring_path, coalesce(p.naics_attractiveness_score, 0.0) AS naics_score,
  coalesce(p.company_opportunity_score, 0.0) AS company_score, coalesce(p.final_score, 0.0) AS final_score,
  'N/A' AS scoring_reason, coalesce(CAST(p.rank AS VARCHAR), 'N/A') AS segment_rank
FROM companies c
JOIN prepared p ON c.company_id = p.company_id
LEFT JOIN (SELECT {strip0_sql('company_id')} AS k, count(*) AS total, count_if(is_served) AS served
           FROM valid_buildings GROUP BY 1) b ON {strip0_sql('c.company_id')} = b.k
LEFT JOIN csum k ON c.company_id = k.company_id
LEFT JOIN churn ch ON c.company_id = ch.company_id
LEFT JOIN research r ON c.company_id = r.company_id
WHERE c.company_id IN (SELECT company_id FROM prepared WHERE scoring_path = 'customer_expansion')"""))


def _fmt1(x):
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE printf('%.1f', {x}) END"


_CONF = "CASE WHEN company_opportunity_score IS NULL THEN 'N/A' ELSE CAST(CAST(round_even(company_opportunity_score / 100.0 * 100.0, 0) AS BIGINT) AS VARCHAR) || '%' END"
oracle("score_formatting", with_ctes(["prepared"], f"""SELECT company_id,
  CASE WHEN naics_attractiveness_score >= 80 THEN '#28a745' WHEN naics_attractiveness_score >= 60 THEN '#ffc107'
       ELSE '#dc3545' END AS industry_color,
  CASE WHEN final_score IS NULL THEN 'gray' WHEN final_score >= 70 THEN 'green' WHEN final_score >= 40 THEN 'yellow' ELSE 'red' END AS badge_color,
  CASE WHEN coalesce(final_score, 0.0) >= 90 THEN 'green' WHEN coalesce(final_score, 0.0) >= 80 THEN 'light_green'
       WHEN coalesce(final_score, 0.0) >= 70 THEN 'yellow' WHEN coalesce(final_score, 0.0) >= 60 THEN 'orange' ELSE 'red' END AS export_band,
  {_fmt1('final_score')} AS score_text,
  CASE WHEN company_opportunity_score IS NULL THEN 'N/A' ELSE printf('%.1f', company_opportunity_score) || '%' END AS company_pct,
  {_CONF} AS confidence_text,
  CASE WHEN final_score IS NULL THEN 'N/A' WHEN company_opportunity_score IS NULL THEN printf('%.1f', final_score)
       ELSE printf('%.1f', final_score) || ' (' || {_CONF} || ' confidence)' END AS score_with_confidence,
  CASE WHEN final_score IS NOT NULL AND company_opportunity_score IS NOT NULL
       THEN printf('%+.1f', final_score - company_opportunity_score) END AS score_delta,
  CASE WHEN final_score IS NULL THEN 'N/A' WHEN final_score * 1000.0 = floor(final_score * 1000.0)
       THEN format('{{:,.0f}}', final_score * 1000.0) ELSE format('{{:,.1f}}', final_score * 1000.0) END AS large_number,
  CASE WHEN icp_fit_score IS NULL THEN 'N/A' ELSE printf('%.2f', icp_fit_score / 100.0) || ' (Calculated)' END AS icp_text
FROM prepared"""))
oracle("buildings_display", with_ctes(["valid_buildings"], """SELECT building_id,
  CASE WHEN coalesce(is_served, false) THEN '✅ Served' ELSE '❌ Unserved' END AS status,
  CASE WHEN square_footage_code IS NULL THEN 'N/A' ELSE format('{:,}', CAST(square_footage_code AS BIGINT)) END AS square_feet
FROM valid_buildings"""))
oracle("building_filters", with_ctes(["valid_buildings"], """SELECT building_id, company_id, source, is_served
FROM valid_buildings WHERE source = 'manual' AND is_served = true"""))


# ------------------------------------------------------- entity resolution
def _norm_sql(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(CAST({x} AS VARCHAR)), '[^a-z0-9]+', ' ', 'g')), '')"


def _given_sql(x: str) -> str:
    return f"CASE WHEN c_custkey % 50 = 0 THEN '-' ELSE {x} END"


CTE["reg"] = f"""reg AS (
  SELECT 'DA' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS dataaxle_id, c_custkey,
         {_given_sql("CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)")} AS street_number,
         {_given_sql("c_name")} AS street, {_given_sql("city")} AS city, {_given_sql("state")} AS state,
         {_given_sql("CAST(10000 + c_nationkey * 37 AS VARCHAR)")} AS zip
  FROM cust_codes)"""
CTE["crm_rec"] = """crm_rec AS (
  SELECT 'HS' || CAST(o.o_orderkey AS VARCHAR) AS hubspot_id, 'building' AS hubspot_type,
         coalesce(CASE WHEN o.o_orderstatus = 'P' THEN CAST(TRY_CAST(r.street_number AS BIGINT) + 1 AS VARCHAR) END,
                  r.street_number) AS street_number,
         CASE WHEN o.o_orderstatus = 'O' THEN replace(r.street, 'Customer', 'Custmer') ELSE r.street END AS street,
         r.city, r.state, CASE WHEN o.o_orderpriority = '5-LOW' THEN '00000' ELSE r.zip END AS zip
  FROM orders o JOIN reg r ON CASE WHEN o.o_orderpriority = '5-LOW' THEN 1 ELSE o.o_custkey END = r.c_custkey)"""
_N = lambda p: ", ".join(f"{_norm_sql(p + c)} AS n_{c.split('_')[-1] if c != 'street_number' else 'number'}"
                         for c in ["street_number", "street", "city", "state", "zip"])
CTE["er_log"] = f"""crm_n AS (SELECT hubspot_id AS rid, hubspot_type, {_N('')} FROM crm_rec),
reg_n AS (SELECT dataaxle_id AS reg, {_N('')} FROM reg),
exact AS (SELECT c.rid, min(r.reg) AS reg FROM crm_n c JOIN reg_n r
          ON c.n_number = r.n_number AND c.n_street = r.n_street AND c.n_city = r.n_city
         AND c.n_state = r.n_state AND c.n_zip = r.n_zip GROUP BY c.rid),
pairs AS (SELECT c.rid, r.reg,
                 CASE WHEN greatest(length(c.n_street), length(r.n_street)) = 0 THEN 100.0
                      ELSE (1.0 - levenshtein(c.n_street, r.n_street) / greatest(length(c.n_street), length(r.n_street))) * 100.0 END AS sim
          FROM crm_n c JOIN reg_n r ON c.n_state = r.n_state AND c.n_city = r.n_city AND c.n_number = r.n_number
          WHERE c.rid NOT IN (SELECT rid FROM exact)),
fuzzy AS (SELECT rid, reg, sim FROM (
            SELECT *, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, reg ASC) AS pos FROM pairs WHERE sim >= 90.0) t
          WHERE pos = 1),
er_log AS (
  SELECT c.rid AS hubspot_id, c.hubspot_type, coalesce(e.reg, f.reg) AS dataaxle_id,
         CASE WHEN e.reg IS NOT NULL THEN 'exact_address_components' WHEN f.reg IS NOT NULL THEN 'fuzzy_street_name'
              ELSE 'unmatched' END AS match_type,
         CASE WHEN e.reg IS NOT NULL THEN 100.0 WHEN f.reg IS NOT NULL THEN round(f.sim, 1) END AS confidence_score
  FROM crm_n c LEFT JOIN exact e ON c.rid = e.rid LEFT JOIN fuzzy f ON c.rid = f.rid)"""
_DEPS.update({"reg": ["cust_codes"], "crm_rec": ["reg"], "er_log": ["crm_rec"]})

oracle("entity_resolution", with_ctes(["er_log"], "SELECT * FROM er_log"))
oracle("er_match_summary", with_ctes(["er_log"], """SELECT match_type, CAST(count(*) AS BIGINT) AS n,
       min(confidence_score) AS min_confidence, max(confidence_score) AS max_confidence
FROM er_log GROUP BY match_type"""))
_ER_GATE = f"""SELECT * FROM ({_gate('entity_resolution', 'non_blocking', 'entity_resolution_log',
    "(SELECT coalesce(avg(CASE WHEN match_type = 'unmatched' THEN 1.0 ELSE 0.0 END), 0.0) FROM er_log)",
    config.ER_ORPHAN_MAX,
    f"(SELECT coalesce(avg(CASE WHEN match_type = 'unmatched' THEN 1.0 ELSE 0.0 END), 0.0) FROM er_log) < {_d(config.ER_ORPHAN_MAX)}")}) g"""
oracle("er_gate", with_ctes(["er_log"], _ER_GATE))
oracle("startup_validation", with_ctes(["filtered", "valid_buildings", "er_log"], "\nUNION ALL\n".join([
    _completeness_sql("filtered"), _dup_sql("filtered", "company_id", "scored.company_id"),
    _dup_sql("valid_buildings", "building_id", "buildings.building_id"),
    _integrity_sql("filtered", "scored->companies"), _integrity_sql("valid_buildings", "buildings->companies"),
    _ER_GATE, _WEIGHTS, _COORD, _RESEARCH])))


# ------------------------------------------------------------- old format
CTE["scored_old"] = f"""scored_old AS (
  SELECT cc.company_id, cc.c_name AS company_name, cc.primary_naics,
         CASE WHEN f.n_urgent >= 3 THEN 'manual' ELSE 'dataaxle' END AS source,
         least(CAST(100 AS DOUBLE), CAST(f.value_cents AS DOUBLE) / {float(SCORE_CENTS_FULL)}) AS standard_score,
         {_d(0.5)} * least(CAST(100 AS DOUBLE), CAST(f.value_cents AS DOUBLE) / {float(SCORE_CENTS_FULL)})
           + {_d(0.5)} * (40.0 + cc.c_nationkey * CAST(2 AS DOUBLE)) AS augmented_score,
         CAST(f.n_finished AS DOUBLE) / f.n_orders AS augmented_confidence,
         greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), cc.c_acctbal / 100.0)) AS icp_fit_score,
         CAST(cc.c_nationkey + 1 AS INTEGER) AS segment_rank, CAST(f.n_urgent AS INTEGER) AS urgent_flags,
         CAST(f.n_finished AS INTEGER) AS action_flags,
         cc.c_custkey IN (SELECT doc_id FROM documents) AS has_research_doc,
         {_CH_CASE.replace('primary_naics', 'cc.primary_naics')} AS channel_id
  FROM cust_codes cc JOIN order_figs f ON cc.c_custkey = f.c_custkey)"""
CTE["prepared_old"] = f"""prepared_old AS (
  SELECT r.*, CAST(coalesce(b.building_count, 0) AS INTEGER) AS building_count
  FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY primary_naics
                 ORDER BY augmented_score DESC NULLS LAST, segment_rank ASC NULLS LAST, company_id ASC NULLS LAST) AS BIGINT) AS segment_rank)
        FROM scored_old
        WHERE company_id IN (SELECT company_id FROM companies)
          AND primary_naics IS NOT NULL AND primary_naics NOT IN ({_EXCL})) r
  LEFT JOIN (SELECT company_id, min(building_count) AS building_count FROM companies GROUP BY company_id) b
    ON r.company_id = b.company_id)"""
_DEPS.update({"scored_old": ["cust_codes", "order_figs"], "prepared_old": ["scored_old", "companies"]})

oracle("ranked_companies_old", with_ctes(["prepared_old"], "SELECT * FROM prepared_old"))
oracle("old_format_display", with_ctes(["prepared_old", "penetration"], """SELECT p.company_id,
  CAST(row_number() OVER (ORDER BY p.augmented_score DESC NULLS LAST, p.company_id ASC NULLS LAST) AS BIGINT) AS global_rank,
  p.segment_rank, p.company_name AS company, 'Prospect' AS scoring_path, coalesce(p.channel_id, 'N/A') AS channel,
  p.augmented_score AS score, coalesce(printf('%.1f', p.augmented_score), '—') AS score_text,
  CASE WHEN coalesce(p.urgent_flags, 0) > 0 THEN '🚨 ' || CAST(p.urgent_flags AS VARCHAR) ELSE '—' END AS urgent,
  CASE WHEN coalesce(p.action_flags, 0) > 0 THEN '✅ ' || CAST(p.action_flags AS VARCHAR) ELSE '—' END AS action,
  CASE WHEN coalesce(p.has_research_doc, false) THEN '📄' ELSE '—' END AS research,
  CASE WHEN n.penetration_rate IS NOT NULL THEN printf('%.1f', n.penetration_rate) || '%' ELSE '—' END AS penetration,
  CAST(coalesce(p.building_count, 0) AS BIGINT) AS buildings,
  CASE p.source WHEN 'dataaxle' THEN '🔵 DataAxle' WHEN 'manual' THEN '🟢 Manual' ELSE p.source END AS source
FROM prepared_old p LEFT JOIN penetration n ON p.company_id = n.company_id"""))
oracle("score_components", with_ctes(["research"], """SELECT company_id, 'ICP Fit Score' AS component,
  icp_fit_score / 100.0 * 100.0 AS value FROM research WHERE icp_fit_score IS NOT NULL"""))
oracle("document_summary", with_ctes(["rdocs"], f"""SELECT company_id,
       CAST(len({words_sql('research_document')}) AS INTEGER) AS word_count,
       {count_sql('research_document', 'URGENT')} AS urgent_flags, {count_sql('research_document', 'ACTION')} AS action_flags,
       len({words_sql('research_document')}) > 0 AS has_content
FROM rdocs"""))


# ---------------------------------------------------------- extra branches
oracle("industry_sorted", with_ctes(["rankings"], "SELECT * FROM rankings"))
oracle("ranked_view_crm", with_ctes(["prepared", "crm_flag"], f"""SELECT *, CAST(row_number() OVER (
       ORDER BY final_score DESC NULLS LAST, company_id ASC NULLS LAST) AS BIGINT) AS global_rank
FROM (SELECT p.*, {_RAW}, coalesce(k.hit, false) AS in_hubspot
      FROM prepared p LEFT JOIN companies c ON p.company_id = c.company_id
      LEFT JOIN crm_flag k ON p.company_id = k.company_id) e
WHERE in_hubspot = true AND state = 'NATION_3' AND final_score BETWEEN 10.0 AND 95.0"""))
oracle("latest_order_per_company", """SELECT company_id, o_orderkey, o_totalprice, o_orderstatus FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, o_orderkey, o_totalprice, o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos
  FROM orders) t WHERE pos = 1""")
oracle("penetration_by_industry", with_ctes(["penetration"], """SELECT c.naics_4digit, CAST(count(*) AS BIGINT) AS companies,
       CAST(sum(p.total_buildings_estimate) AS BIGINT) AS total_buildings_estimate,
       CAST(sum(p.served_buildings) AS BIGINT) AS served_buildings,
       CASE WHEN sum(p.total_buildings_estimate) = 0 THEN NULL
            ELSE CAST(sum(p.served_buildings) AS DOUBLE) / CAST(sum(p.total_buildings_estimate) AS DOUBLE) * 100.0 END AS penetration_rate
FROM penetration p JOIN (SELECT DISTINCT company_id, naics_4digit FROM companies) c ON p.company_id = c.company_id
WHERE c.naics_4digit IS NOT NULL GROUP BY c.naics_4digit"""))
oracle("industry_search_multiword", with_ctes(["rankings"], _text_search_sql("estate")))
oracle("segment_sorted", with_ctes(["prepared"], "SELECT company_id, primary_naics, final_score, rank FROM prepared"))


# ------------------------------------------------------------------ rows in file order
CTE["register"] = """register AS (
  SELECT CAST(o_custkey AS VARCHAR) AS company_id, CAST(floor(o_totalprice / 1000) AS INTEGER) AS building_count_estimate,
         substr(o_orderpriority, 1, 1) AS growing_business_code,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(month(o_orderdate) AS INTEGER) END AS contacts_count,
         CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.customer' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.example.com/'
              ELSE 'https://elsewhere.example.com' END AS website,
         round(o_totalprice) / 10.0 AS penetration_rate, 'Order ' || CAST(o_orderkey AS VARCHAR) AS reasoning,
         CASE WHEN o_orderkey % 2 = 0 THEN 'pursue' END AS recommendation, row_number() OVER () AS file_order
  FROM orders),
first_row AS (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY file_order) = 1),
last_row AS (SELECT * FROM register QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY file_order DESC) = 1)"""
_DEPS["register"] = []
oracle("first_raw_fields", with_ctes(["filtered", "register"], """SELECT f.company_id, r.building_count_estimate, r.growing_business_code, r.contacts_count
FROM filtered f LEFT JOIN first_row r ON r.company_id = f.company_id"""))
oracle("last_penetration_rate", with_ctes(["filtered", "register"], """SELECT f.company_id, r.penetration_rate
FROM filtered f LEFT JOIN last_row r ON r.company_id = f.company_id"""))
oracle("last_website_presence", with_ctes(["filtered", "register"], """SELECT f.company_id,
       coalesce(r.website LIKE 'https://www.%' AND EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_custkey AS VARCHAR) = f.company_id
                AND o.o_orderpriority = '1-URGENT'), false) AS in_hubspot
FROM filtered f LEFT JOIN last_row r ON r.company_id = f.company_id"""))
oracle("export_first_rows", with_ctes(["filtered", "register"], """SELECT f.company_id, f.company_name, f.rank, f.final_score, 'own' AS reasoning,
       false AS in_hubspot, r.reasoning AS reasoning_research, r.recommendation, r.website, r.building_count_estimate,
       r.growing_business_code, r.contacts_count
FROM filtered f LEFT JOIN first_row r ON r.company_id = f.company_id"""))
oracle("company_lookup", with_ctes(["filtered", "register"], """SELECT r.company_id, r.building_count_estimate, r.website, r.reasoning
FROM first_row r WHERE r.company_id IN (SELECT company_id FROM filtered WHERE is_customer)"""))


# ------------------------------------------------------------------ readers and sink
oracle("scan_companies", with_ctes(["companies"], """SELECT company_id, name, primary_naics, hq_latitude, hq_longitude,
       building_count_estimate AS building_count, building_count_estimate, website, growing_business_code, contacts_count, city, state,
       employees, sales_volume FROM companies"""))
oracle("scan_buildings", with_ctes(["buildings", "companies"], """SELECT *, square_footage_code AS square_footage FROM buildings
WHERE company_id IN (SELECT company_id FROM companies)"""))
oracle("scan_buildings_flags", with_ctes(["buildings"], """SELECT building_id, source, CASE WHEN source <> 'hubspot' THEN is_served END AS is_served
FROM buildings"""))
oracle("scan_scored", with_ctes(["scored"], "SELECT * FROM scored"))
oracle("scan_scored_old", with_ctes(["scored_old"], "SELECT * FROM scored_old"))
oracle("scan_research", with_ctes(["research"], "SELECT company_id, had_web_research, icp_fit_score, confidence, reasoning, timing FROM research"))
oracle("scan_churn", with_ctes(["churn"], "SELECT company_id, churn_probability, risk_tier, prediction_date FROM churn"))
oracle("scan_crm", with_ctes(["crm"], "SELECT domain FROM crm"))
oracle("scan_metrics", with_ctes(["metrics"], """SELECT naics_code, naics_description, attractiveness_score, icp_fit_score, market_size_score,
       market_size_count FROM metrics"""))
oracle("scan_codes", with_ctes(["metrics"], "SELECT naics_code, naics_description AS description FROM metrics"))
oracle("scan_interactions", """SELECT CAST(event_id AS VARCHAR) AS engagement_id, CAST(user_id AS VARCHAR) AS company_id, event_type AS engagement_type,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, props AS body FROM events""")
oracle("scan_penetration", ORACLE["penetration_estimates"])
oracle("scan_contacts", ORACLE["contact_summary"])
oracle("scan_er_log", ORACLE["entity_resolution"])
oracle("export_sink", f"""SELECT 'Company Rankings' AS table_name, count(*) AS n_rows FROM ({ORACLE['export_rankings']}) a
UNION ALL SELECT 'ICP Detailed Reasoning', count(*) FROM ({ORACLE['export_reasoning']}) b
UNION ALL SELECT 'Web Research Details', count(*) FROM ({ORACLE['export_research']}) c HAVING count(*) > 0
UNION ALL SELECT 'Export Metadata', count(*) FROM ({ORACLE['export_manifest']}) d""")
oracle("contacts_display", f"""SELECT coalesce(contact_count, 0) AS "Contact Count", coalesce(contact_names, 'N/A') AS "Contact Names",
       coalesce(contact_emails, 'N/A') AS "Contact Emails", coalesce(last_contact_date, 'N/A') AS "Last Contact"
FROM ({ORACLE['contact_summary']}) c""")
oracle("buildings_table", with_ctes(["valid_buildings", "companies"], """SELECT c.city, c.state,
       CASE WHEN b.is_served THEN '✅ Served' ELSE '❌ Unserved' END AS status, square_footage_code AS square_feet
FROM valid_buildings b LEFT JOIN companies c ON c.company_id = b.company_id"""))


# ------------------------------------------------------------------ an owner's config documents, bounded lists
def _own_channel(code: str) -> str:
    """Longest prefix first."""
    rows = sorted(((p, ch) for ch, spec in OWN_CHANNELS["channels"].items() for p in spec["naics_codes"]), key=lambda x: -len(x[0]))
    return "CASE " + " ".join(f"WHEN starts_with({code}, '{p}') THEN '{ch}'" for p, ch in rows) + f" ELSE '{OWN_CHANNELS['default_channel']}' END"


def _own_weight(component: str) -> str:
    rows = [(ch, spec.get("score_weights_override", {}).get(component)) for ch, spec in OWN_CHANNELS["channels"].items()]
    return ("CASE channel_id " + " ".join(f"WHEN '{ch}' THEN {_d(w)}" for ch, w in rows if w is not None)
            + f" ELSE {_d(config.BASE_CHANNEL_WEIGHTS[component])} END AS {component}")


oracle("config_channels", with_ctes(["scored"], f"""SELECT *, {_own_weight('geographic_fit')}, {_own_weight('hygiene_relevance')}
FROM (SELECT company_id, primary_naics, {_own_channel('primary_naics')} AS channel_id FROM scored) s"""))
oracle("config_targets", with_ctes(["filtered"], f"""SELECT company_id, naics_4digit, final_score, max_companies
FROM (SELECT f.company_id, f.naics_4digit, f.final_score, CAST(t.n AS INTEGER) AS max_companies,
             row_number() OVER (PARTITION BY f.naics_4digit ORDER BY final_score DESC NULLS LAST, company_id) AS place
      FROM filtered f JOIN (VALUES {', '.join(f"('{c}', {n})" for c, n in OWN_TARGETS)}) t(code, n) ON t.code = f.naics_4digit) x
WHERE place <= max_companies"""))
oracle("config_sqft", with_ctes(["buildings"], f"""SELECT building_id, square_footage_code, c.r AS sqft_range, c.inc IS NULL AS sqft_unknown
FROM buildings b LEFT JOIN (VALUES {', '.join(f"('{c}', '{r}', {inc})" for c, r, _, _, inc in OWN_SQFT)}) c(code, r, inc) ON c.code = square_footage_code
WHERE source = 'manual' OR coalesce(c.inc, true)"""))
oracle("six_digit_targets", with_ctes(["companies"], f"""SELECT company_id, primary_naics FROM companies
WHERE substr(primary_naics, 1, 6) IN ({', '.join(f"'{c}'" for c in OWN_SIX_DIGIT)}) AND building_count_estimate - 1 > 0"""))
oracle("contact_lists", with_ctes(["contacts"], """SELECT company_id, kind, CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n_values,
       string_agg(value, '; ' ORDER BY value) AS text
FROM (SELECT *, (row_number() OVER (PARTITION BY company_id, kind ORDER BY value) - 1) // 3 AS chunk
      FROM (SELECT DISTINCT company_id, 'email' AS kind, contact_email AS value FROM contacts WHERE contact_email IS NOT NULL
            UNION ALL SELECT DISTINCT company_id, 'name', contact_name FROM contacts WHERE contact_name IS NOT NULL) d) v
GROUP BY company_id, kind, chunk"""))


def _py_string_sql(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


oracle("json_objects", f"""SELECT CAST(doc_id AS VARCHAR) AS company_id, CAST(0 AS INTEGER) AS n_items,
  '{{''z'': None, ''mixed'': [1, ''two'', True, None, {{''b'': 2.5}}]' || coalesce(', ''note'': ' || {_py_string_sql('text')}, '')
  || coalesce(', ''lang'': ' || {_py_string_sql('lang')}, '') || ', ''id'': ' || CAST(doc_id AS VARCHAR)
  || ', ''about'': {{''size'': ' || CAST(n_chars AS VARCHAR) || ', ''long'': ' || CASE WHEN n_chars > 2000 THEN 'True' ELSE 'False' END
  || ', ''a'': "it''s"}}, ''tags'': [' || {_py_string_sql('source')} || ', ''x'']}}' AS items
FROM documents""")
