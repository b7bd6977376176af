"""Config files (S15): exclusions, channels, industry targets, square-footage
codes. They are small documents, read on the driver through Spark's reader, so that they may lie in
any store; the result feeds the operators as plain Python values (literal
``isin`` lists) or as tiny frames. A given path is followed exactly: a document that is missing, cannot be
read, or lacks a required key raises ``ConfigError``, and nothing is replaced by built-in values behind
the owner's back (exclusions alone are optional: a missing file excludes nothing). Without a path the
fixed values in ``config`` hold.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .. import config

try:  # optional dependency
    import yaml  # type: ignore
except ImportError:  # pragma: no cover
    yaml = None


class ConfigError(ValueError):
    pass


#: Versions of the documents that this reader understands (the part before the first dot).
KNOWN_VERSIONS = {"1"}


def _required(path: str, key: str) -> dict:
    """The document at ``path``, which must hold ``key`` and be of a known version."""
    doc = _read(path)
    if doc is None:
        raise ConfigError(f"{path}: no such file")
    if not isinstance(doc, dict) or key not in doc:
        raise ConfigError(f"{path}: missing {key!r}")
    version = str(doc.get("version", "1.0"))
    if version.split(".")[0] not in KNOWN_VERSIONS:
        raise ConfigError(f"{path}: version {version} is not known")
    return doc


def _read(path: str):
    """A YAML document from any store that Spark reads; None if there is no such file."""
    try:
        # one small file, or a folder with one
        rows = SparkSession.active().read.text(path, wholetext=True).limit(2).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if len(rows) > 1:
        raise ConfigError(f"{path}: more than one document")
    text = rows[0].value if rows else ""
    if yaml is None:
        raise ConfigError(f"{path}: reading config files needs PyYAML")
    return yaml.safe_load(text)


def load_exclusions(path: str | None) -> dict:
    """Exclusion groups ({name: {enabled, naics_codes, ...}}); only mapping
    entries count (a 'version' key or comments are ignored). Without a path
    the built-in groups hold; a path that does not exist excludes nothing; a
    file that cannot be read raises."""
    if not path:
        return dict(config.EXCLUSIONS)
    doc = _read(path)
    return {k: v for k, v in (doc or {}).items() if isinstance(v, dict)}


def excluded_codes(path: str | None) -> list[str]:
    return config.excluded_naics_codes(load_exclusions(path))


def load_channels(path: str | None) -> tuple[dict, str]:
    """(channels, default_channel); the 'channels' key is required."""
    if not path:
        return dict(config.CHANNELS), config.DEFAULT_CHANNEL
    doc = _required(path, "channels")
    chans = {}
    for name, spec in (doc.get("channels") or {}).items():
        spec = spec or {}
        chans[name] = {"name": spec.get("name", name),
                       "naics_codes": [str(c).strip() for c in spec.get("naics_codes") or []],
                       "priority": spec.get("priority"),
                       "score_weights_override": dict(spec.get("score_weights_override") or {})}
    return chans, str(doc.get("default_channel", config.DEFAULT_CHANNEL))


def load_naics_targets(path: str | None) -> list[tuple[str, int]]:
    """(4-digit code, max companies) per target industry."""
    if not path:
        return list(config.NAICS_TARGETS)
    doc = _required(path, "target_naics")
    return [(str(t["naics_code"]).strip(), int(t["max_companies"])) for t in doc.get("target_naics") or []]


def load_six_digit_targets(path: str | None) -> list[str]:
    """Six-digit target codes."""
    if not path:
        return list(config.TARGET_SIX_DIGIT)
    return [str(c).strip() for c in _required(path, "target_codes").get("target_codes") or []]


def load_sqft_codes(path: str | None) -> list[tuple]:
    """(code, range text, min, max, include) per square-footage code."""
    if not path:
        return list(config.SQFT_CODES)
    out = []
    for code, m in (_required(path, "code_mappings").get("code_mappings") or {}).items():
        out.append((str(code), m.get("range"), m.get("range_sqft_min"), m.get("range_sqft_max"),
                    bool(m.get("include"))))
    return out
