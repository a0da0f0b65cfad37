"""Names of scans, sessions, contrasts and features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scanner codes with model and vendor, tag orders, feature families.
SCANNERS = {
    "NOT1ACH": ("Philips Achieva", "Philips"),
    "NOT2ING": ("Philips Ingenia", "Philips"),
    "NOT3GEM": ("GE MR750", "GE"),
    "NOT4GEP": ("GE Premier 48ch", "GE"),
    "OXF1PRI": ("Siemens Prisma 32ch", "Siemens"),
    "OXF2PRI": ("Siemens Prisma 64ch", "Siemens"),
    "OXF3TRI": ("Siemens Trio", "Siemens"),
    "OXF4GEP": ("GE Premier 21ch", "GE"),
}
MODALITY_TAGS = ("task", "acq", "dir", "run", "echo", "part")
ACQUISITION_TAGS = ("acq", "dir", "run", "echo", "part", "task")
FAMILIES = ("firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm", "shape")
CONTRAST_ALIASES = {"t1": "t1w", "t2": "t2w"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def bids_entities(name: Column) -> Column:
    """key-value parts as a map; a part without a dash is the suffix; the last of a key wins."""
    stem = F.replace(F.replace(name, F.lit(".nii.gz"), F.lit("")), F.lit(".nii"), F.lit(""))
    pair = lambda p: F.struct(
        F.when(F.contains(p, F.lit("-")), F.substring_index(p, "-", 1)).otherwise("suffix").alias("key"),
        F.when(F.contains(p, F.lit("-")), F.expr("null").cast("string")).otherwise(p).alias("bare"), p.alias("part"),
    )
    value = lambda e: F.coalesce(e["bare"], F.substring(e["part"], F.length(e["key"]) + 2, F.length(e["part"])))

    def entries(parts: Column) -> Column:
        last = F.filter(parts, lambda e, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda later: later["key"] == e["key"]))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], value(e))))

    # The parts are an element of an array of one, so that every use of them in entries is one variable: the name is split once.
    return F.get(F.transform(F.array(F.transform(F.split(stem, "_"), pair)), entries), F.lit(0))


def _tags(entities: Column, order: tuple[str, ...]) -> Column:
    return F.concat_ws("_", *[F.concat(F.lit(f"{k}-"), entities[k]) for k in order])


def modality_id(entities: Column) -> Column:
    tags = _tags(entities, MODALITY_TAGS)
    suffix = F.coalesce(entities["suffix"], F.lit("unknown"))
    return F.when(tags == "", suffix).otherwise(F.concat_ws("_", suffix, tags))


def acquisition_tag(entities: Column) -> Column:
    return _tags(entities, ACQUISITION_TAGS)


def scanner(session: Column) -> Column:
    """Struct (model, vendor) by the session's code, Unknown where it is not listed."""
    table = F.create_map(*[x for k, (m, v) in SCANNERS.items() for x in (F.lit(k), F.struct(F.lit(m).alias("model"), F.lit(v).alias("vendor")))])
    code = F.substring(F.replace(session, F.lit("ses-"), F.lit("")), 1, 7)
    return F.coalesce(F.try_element_at(table, code), F.struct(F.lit("Unknown").alias("model"), F.lit("Unknown").alias("vendor")))


def scanner_of_session(session: Column) -> Column:
    """The code in ses-CODE123; anything else is an error."""
    found = F.regexp_extract(session, r"^ses-([A-Z][A-Z0-9]+)\d{3}$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("not a session: "), F.coalesce(session, F.lit("null")))).cast("string"))


def base_modality(m: Column) -> Column:
    return F.coalesce(F.split(m, "_")[0], F.lit("unknown"))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def contrast(name: Column, available: list[str]) -> Column:
    """Trimmed, lower-cased and unaliased; a name that is not available is an error."""
    low = F.lower(F.trim(name))
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONTRAST_ALIASES.items() for x in kv]), low), low)
    return F.when(out.isin(available), out).otherwise(F.raise_error(F.concat(F.lit("unknown contrast: "), out)).cast("string"))


def feature_family(name: Column) -> Column:
    out = F.lit("other")
    for f in reversed(FAMILIES):
        out = F.when(F.contains(F.lower(name), F.lit(f)), f).otherwise(out)
    return out


def short_name(name: Column) -> Column:
    """A feature's name without image type and family."""
    return F.regexp_replace(name, r"^(original_|log-sigma-[^_]*_|wavelet-[^_]*_)?(" + "|".join(FAMILIES) + ")_", "")


def strip_prefixes(key: Column, prefixes: tuple[str, ...] = ("module.", "_orig_mod.", "model.", "network.")) -> Column:
    """Known prefixes removed from the front, again and again."""
    return F.regexp_replace(key, "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")+", "")


def parse_enabled(text: Column) -> Column:
    """Missing and empty cells count as enabled; what is neither yes nor no is an error."""
    low = F.lower(F.trim(text))
    return (
        F.when(text.isNull() | low.isin("", "1", "true", "yes", "y"), True)
        .when(low.isin("0", "false", "no", "n"), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), low)).cast("boolean"))
    )


def subject_id(path: Column, subject: Column) -> Column:
    """The subject as given, else the file's name without its ending."""
    return F.coalesce(subject, F.regexp_replace(file_name(path), r"\.nii(\.gz)?$", ""))


def mode_name(mode: Column, tta: Column) -> Column:
    return F.concat_ws("_", mode, F.when(tta, "tta"))


def method_of_run(run_id: Column) -> Column:
    return F.split(run_id, "_")[0]
