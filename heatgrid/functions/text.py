"""Names and texts: scenario names out of paths, safe names, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(number: Column) -> Column:
    return number.try_cast("double").cast("int").cast("string")


def _plain(number: Column) -> Column:
    """Without a fraction of zero."""
    return F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _digits(text: Column) -> Column:
    """Whether a text is digits and dots alone, and not empty."""
    return text.rlike(r"^[0-9.]+$")


def _degrees(file: Column, bare: bool) -> tuple[Column, Column]:
    """The numbers before `deg` and `uhi` of the tokens <number>deg, <number>uhi that follow each other in a name, after a token that begins with `scenario`.

    bare: the token right before them is `scenario` or ends in it; else it may have a number, and words of letters and
    digits may stand between. Null without such tokens.
    """
    def found(tokens: Column) -> Column:
        def fits(i: Column) -> Column:
            deg, uhi = F.get(tokens, i), F.get(tokens, i + 1)
            pair = deg.endswith("deg") & _digits(F.substring(deg, F.lit(1), F.length(deg) - 3)) & _digits(F.element_at(F.split(uhi, "uhi"), 1)) & uhi.contains("uhi")
            before = F.slice(tokens, F.lit(1), i)
            if bare:
                return pair & F.element_at(before, -1).endswith("scenario")
            heads = F.transform(before, lambda t: F.substring_index(t, "scenario", -1).rlike("^[0-9]*$") & t.contains("scenario"))
            words = F.transform(before, lambda t: t.rlike("^[A-Za-z0-9]+$"))
            last = F.size(heads) - F.array_position(F.reverse(heads), True)  # place of the last head, from 0
            return pair & F.array_contains(heads, True) & ~F.array_contains(F.slice(words, (last + 2).cast("int"), F.size(words)), False)

        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(1))), lambda i: F.coalesce(fits(i), F.lit(False)))
        first = F.when(F.size(tokens) > 2, F.get(at, F.lit(0)))
        return _bound(first, lambda i: F.struct(F.substring_index(F.get(tokens, i), "deg", 1).alias("deg"), F.substring_index(F.get(tokens, i + 1), "uhi", 1).alias("uhi")))

    own = _bound(F.split(file, "_"), found)
    return own["deg"], own["uhi"]


def _named_degrees(file: Column) -> tuple[Column, Column]:
    """The first number right before a `deg_` that a number right before a `uhi` follows, and that one, in any case; fractions stay."""
    number = lambda text: F.nullif(F.regexp_extract(text, r"(\d+([.]\d+)?)$", 1), F.lit(""))
    parts = F.split(F.lower(file), "deg_")

    def pair(part: Column, i: Column) -> Column:
        later = F.split(F.array_join(F.slice(parts, i + 2, F.size(parts)), "deg_"), "uhi")
        ended = F.filter(F.transform(F.slice(later, F.lit(1), F.size(later) - 1), number), lambda n: n.isNotNull())
        return F.struct(number(part).alias("deg"), F.get(ended, F.lit(0)).alias("uhi"))

    whole = F.filter(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), pair), lambda p: p["deg"].isNotNull() & p["uhi"].isNotNull())
    first = F.get(whole, F.lit(0))
    return first["deg"], first["uhi"]


def short_name(path: Column, base: str, form: str = "strict") -> Column:
    """`<folder under base>_<deg>_<uhi>` out of a result file's path; null where the path is not of the form.

    strict: the file's name has scenario_<deg>deg_<uhi>uhi. suffix: a number and further words may follow `scenario`.
    named: the first folder with `scenario` in its name, <deg>deg_ and later <uhi>uhi, in any case; fractions stay; outside
    of the base the file's folder. lenient: as strict, but the folder alone where the numbers are missing, and the file's
    folder outside of the base.
    """
    base = base.rstrip("/")
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    parent = F.when(path.isNotNull(), F.when(file != "", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))).otherwise(""))
    under = F.when(path.startswith(base + "/"), F.split(F.substring(path, F.lit(len(base) + 2), F.length(path)), "/"))
    folders = F.slice(under, 1, F.greatest(F.size(under) - 1, F.lit(0)))
    folder = F.nullif(F.get(folders, F.lit(0)), F.lit(""))
    if form == "named":
        number, (deg, uhi) = _plain, _named_degrees(file)
        named = F.get(F.filter(folders, lambda f: F.lower(f).contains("scenario")), F.lit(0))
        folder = F.coalesce(named, folder, parent)
    else:
        number, (deg, uhi) = _whole, _degrees(file, form != "suffix")
        folder = F.coalesce(folder, parent) if form == "lenient" else folder
    name = F.when(folder.isNotNull() & deg.isNotNull() & uhi.isNotNull(), F.concat_ws("_", folder, number(deg), number(uhi)))
    return F.coalesce(name, folder) if form == "lenient" else name


def zonal_scenario(name: Column) -> Column:
    """The scenario block of names such as scenario4_10prc_zonal_stats_mean.csv; `scenario` where there is none.

    It is a word `scenario` with a number or none, and the words of letters and digits from there to _zonal_stats_.
    """
    file = F.element_at(F.split(name, r"[/\\]"), -1)
    tail = F.substring_index(file, "_zonal_stats_", -1)
    words = F.split(F.substring(file, F.lit(1), F.length(file) - F.length(tail) - len("_zonal_stats_")), "_")

    def block(word: Column, i: Column) -> Column:
        number, rest = F.substring_index(word, "scenario", -1), F.slice(words, i + 2, F.size(words))
        fits = word.contains("scenario") & number.rlike("^[0-9]*$") & ~F.exists(rest, lambda w: ~w.rlike("^[A-Za-z0-9]+$"))
        return F.when(fits, F.array_join(F.concat(F.array(F.concat(F.lit("scenario"), number)), rest), "_"))

    found = F.get(F.array_compact(F.transform(words, block)), F.lit(0))
    named = file.contains("_zonal_stats_") & tail.endswith(".csv") & (F.length(tail) > 4)
    return F.coalesce(F.when(named, found), F.lit("scenario"))


def scenario_of_file(path: Column) -> Column:
    """The scenario token of a result file's name, without what follows its first underscore pair."""
    return F.nullif(F.regexp_extract(path, r"(scenario\d*(?:_[A-Z]{2}|_\d+)?)", 1), F.lit(""))


def climate_file_parts(name: Column) -> tuple[Column, Column, Column]:
    """Model, emission pathway and period of names such as tas_MODEL_ssp245_2041-2060.csv."""
    form = r"_([A-Za-z0-9-]+)_(ssp\d+|historical)_(\d{4}-\d{4})"
    return tuple(F.nullif(F.regexp_extract(name, form, i), F.lit("")) for i in (1, 2, 3))


def safe_name(text: Column) -> Column:
    """Lower case; runs of anything but letters, digits and dots are one underscore, none at the ends."""
    text = F.regexp_replace(text, "[^a-zA-Z0-9._]", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", ""))


def clean_number(text: Column) -> Column:
    """Text to a number: thousands' commas and white space go, what is no number is null."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def split_parts(text: Column, delimiter: str, n: int) -> list[Column]:
    """The first n parts; missing ones are null."""
    parts = F.split(text, F.lit("\\Q" + delimiter + "\\E"), n)
    return [F.get(parts, F.lit(i)) for i in range(n)]


def key_values(line: Column) -> Column:
    """A map from `key: value` pairs in a line."""
    form = F.lit(r"(\S+?):\s*(\S+)")
    return F.map_from_arrays(F.regexp_extract_all(line, form, F.lit(1)), F.regexp_extract_all(line, form, F.lit(2)))


def stars(p: Column) -> Column:
    """Significance marks."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")
