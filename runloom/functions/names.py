"""Parsing of directory, file and job names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number patterns in checkpoint file names, in the order they are tried.
EPOCH_PATTERNS = {
    "resolver": [r"epoch[=_-](\d+)", r"epoch(\d+)", r"ep(\d+)"],
    "core": [r"epoch_(\d+)", r"epoch(\d+)", r"checkpoint_(\d+)", r"step_(\d+)"],
    "lightning": [r"epoch[=_](\d+)", r"epoch(\d+)", r"checkpoint[_-](\d+)", r"step[=_](\d+)"],
    "step": [r"step[=_-](\d+)", r"step(\d+)"],
}
# Evaluation splits recognised inside a directory name.
KNOWN_SPLITS = ["navtest", "navhard", "navmini"]
EXPERIMENT_ID = r"(?i)(exp_[a-z]\d+)"


def _blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_eval_dir(name: Column, scopes: Sequence[str]) -> Column:
    """``{exp}_eval_{split}[_{scope}]_{date}_{time}[_{job}]`` as a struct.

    A name without exactly one ``_eval_`` is an experiment id by itself. The second token is a
    scope only when it is a known one.
    """
    halves = F.split(name, "_eval_")
    tokens = F.split(F.try_element_at(halves, F.lit(2)), "_")
    second = F.try_element_at(tokens, F.lit(2))
    has_scope = F.coalesce(second.isin(list(scopes)), F.lit(False)) if scopes else F.lit(False)
    start = F.when(has_scope, 3).otherwise(2)
    stamp_day = F.try_element_at(tokens, start)
    stamp_time = F.try_element_at(tokens, start + 1)
    parsed = F.size(halves) == 2
    return F.struct(
        F.when(parsed, halves[0]).otherwise(name).alias("exp_id"),
        F.when(parsed, tokens[0]).alias("eval_split"),
        F.when(parsed & has_scope, second).alias("scope"),
        F.when(parsed & stamp_time.isNotNull(), F.concat(stamp_day, F.lit("_"), stamp_time)).alias("timestamp"),
        F.when(parsed & stamp_time.isNotNull(), F.try_element_at(tokens, start + 2)).alias("slurm_job_id"),
    )


def base_and_stamp(name: Column) -> Column:
    """``name_YYYYMMDD_HHMMSS`` as struct(base, stamp); an invalid date keeps the whole name."""
    text = F.regexp_extract(name, r"^.*_(\d{8}_\d{6})$", 1)
    stamp = F.try_to_timestamp(_blank_to_null(text), F.lit("yyyyMMdd_HHmmss"))
    base = F.substring(name, F.lit(1), F.length(name) - 16)
    return F.struct(F.when(stamp.isNotNull(), base).otherwise(name).alias("base"), stamp.alias("stamp"))


def scope_label(name: Column, scopes: Sequence[str], overall: str = "all") -> Column:
    """First declared scope found between ``_``/``-`` boundaries, any case, else ``overall``."""
    lowered = F.lower(name)
    padded = F.concat(F.lit("_"), F.translate(lowered, "-", "_"), F.lit("_"))
    found = []
    for scope in scopes:
        low = scope.lower()
        if re.search("[_-]", low):
            hit = lowered.rlike(rf"(^|[_-])\Q{low}\E($|[_-])")
        else:
            hit = F.contains(padded, F.lit(f"_{low}_"))
        found.append(F.when(hit, F.lit(scope)))
    return F.coalesce(*found, F.lit(overall))


def substring_label(name: Column, labels: Sequence[str], default: str = "all") -> Column:
    """First label occurring anywhere in the lower-cased name."""
    return F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(label)), F.lit(label)) for label in labels],
                      F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    name = file_name(path)
    cut = F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1
    return F.when(cut > 0, F.substring(name, F.lit(1), cut)).otherwise(name)


def number_in_name(path: Column, style: str = "resolver", missing: int | None = -1) -> Column:
    """Epoch or step number of a file name by the first matching pattern of ``style``.

    The patterns are alternatives of one expression that starts at the beginning, so an earlier
    pattern anywhere in the name wins over a later one, in a single pass.
    """
    patterns = EPOCH_PATTERNS[style]
    anywhere = "|".join(f".*?{p}" for p in patterns)
    groups = "".join(f"${i}" for i in range(1, len(patterns) + 1))
    digits = F.regexp_replace(file_stem(path), f"(?is)^(?:{anywhere}|).*$", groups)
    return F.coalesce(_blank_to_null(digits).try_cast("bigint"), F.lit(missing).cast("bigint"))


def epoch_in_path(path: Column) -> Column:
    """``epoch=N`` anywhere in the path; ``last.ckpt`` counts as -1, anything else is NULL."""
    number = _blank_to_null(F.regexp_extract(path, r"epoch=(\d+)", 1)).try_cast("bigint")
    return F.coalesce(number, F.when(F.contains(path, F.lit("last.ckpt")), F.lit(-1).cast("bigint")))


def eval_name_parts(name: Column) -> Column:
    """``eval_{split}_{exp}_...`` as struct(eval_split, exp_id), 'unknown' when it is not that."""
    parts = F.split(name, "_")
    usable = F.startswith(name, F.lit("eval_")) & (F.size(parts) >= 3)
    unknown = F.lit("unknown")
    return F.struct(
        F.coalesce(F.when(usable, F.try_element_at(parts, F.lit(2))), unknown).alias("eval_split"),
        F.coalesce(F.when(usable, F.try_element_at(parts, F.lit(3))), unknown).alias("exp_id"),
    )


def split_in_name(name: Column, splits: Sequence[str] = tuple(KNOWN_SPLITS)) -> Column:
    return substring_label(name, splits, "unknown")


def experiment_in_name(name: Column, pattern: str = EXPERIMENT_ID) -> Column:
    """The experiment id inside a name, NULL when there is none."""
    return _blank_to_null(F.regexp_extract(name, pattern, 1))


def display_stamp(stamp: Column) -> Column:
    """``YYYYMMDD_HHMM..`` as ``YYYY-MM-DD HH:MM``; short texts stay, empty ones give '-'."""
    long = F.concat(F.substring(stamp, 1, 4), F.lit("-"), F.substring(stamp, 5, 2), F.lit("-"),
                    F.substring(stamp, 7, 2), F.lit(" "), F.substring(stamp, 10, 2), F.lit(":"),
                    F.substring(stamp, 12, 2))
    return F.when(F.length(stamp) >= 15, long).otherwise(F.coalesce(_blank_to_null(stamp), F.lit("-")))


def is_name_of(name: Column, exp_id: Column) -> Column:
    """Strict id match: the id is the name or a ``_``-delimited part of it (A3 is not A3-b)."""
    bar = F.lit("_")
    return F.contains(F.concat(bar, name, bar), F.concat(bar, exp_id, bar))


def is_job_of(name: Column, exp_id: Column) -> Column:
    """The id itself, or the id followed by one of ``_ - .``."""
    following = F.substring(name, F.length(exp_id) + 1, F.lit(1))
    return F.startswith(name, exp_id) & ((F.length(name) == F.length(exp_id)) | following.isin("_", "-", "."))


def id_candidates(name: Column) -> Column:
    """All ids a name can belong to: its contiguous runs of ``_``-separated tokens.

    Turns the strict id match into an equi-join on the exploded candidates.
    """
    tokens = F.split(name, "_")
    n = F.size(tokens)
    runs = F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda start: F.transform(
            F.sequence(F.lit(1), n - start + 1),
            lambda length: F.array_join(F.slice(tokens, start, length), "_"))))
    return F.array_distinct(runs)


def id_prefixes(name: Column) -> Column:
    """All ids a job name can belong to: its prefixes ending at the end or before ``_ - .``."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(name)),
                    lambda i: F.substring(name, i + 1, F.lit(1)).isin("", "_", "-", "."))
    return F.when(F.length(name) > 0, F.transform(cuts, lambda i: F.substring(name, F.lit(1), i)))


def id_suffixes(name: Column) -> Column:
    """All suffixes starting after a ``_`` (the whole name is not one), longest first."""
    tokens = F.split(name, "_")
    n = F.size(tokens)
    return F.when(n > 1, F.transform(
        F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(tokens, i, n), "_"))).otherwise(
        F.array().cast("array<string>"))


def slug(text: Column, default: str = "experiment") -> Column:
    """A folder-safe name: accents folded, lower case, non-word runs as one ``_``.

    Folding covers letters and digits of the basic plane that decompose into ASCII, also into several letters (ligatures);
    other non-ASCII characters are dropped.
    """
    folded = F.translate(text, *ACCENTS)
    for letter, letters in LIGATURES:
        folded = F.replace(folded, F.lit(letter), F.lit(letters))
    plain = F.octet_length(text) == F.char_length(text)
    ascii_text = F.when(plain, text).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))
    body = F.regexp_replace(F.lower(ascii_text), r"\W+", "_")
    return F.coalesce(_blank_to_null(F.trim(body, F.lit("_"))), F.lit(default))


def _folds() -> list[tuple[str, str]]:
    """Every letter and digit of the basic plane whose compatibility decomposition leaves ASCII."""
    import unicodedata

    folds = []
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        if unicodedata.category(chr(code))[0] in "LN":
            folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
            if folded.isalnum():
                folds.append((chr(code), folded))
    return folds


# Compatibility folds to one letter and to several, derived from Unicode rather than listed.
ACCENTS = tuple("".join(part) for part in zip(*[f for f in _folds() if len(f[1]) == 1]))
LIGATURES = [f for f in _folds() if len(f[1]) > 1 and f[0].isalpha()]


def substitute_vars(template: Column, known: Mapping[str, Column | str]) -> Column:
    """Replace ``${name}`` for every known name; unknown ones stay as they are."""
    for name, value in known.items():
        new = value if isinstance(value, Column) else F.lit(str(value))
        placeholder = "${" + name + "}"
        template = F.when(new.isNull(), template).otherwise(
            F.replace(template, F.lit(placeholder), new.cast("string")))
    return template


def short_text(text: Column, limit: int = 50, keep: int = 47) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)
