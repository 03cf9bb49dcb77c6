"""Text cleaning and key normalising as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters dropped at the ends of a cleaned text, and words always written in capitals.
EDGES = " \t\r\n\"'`.,;:()[]{}<>|\\/"
CAPITALS = ("A/S AS ASA BV CO CORP DMCC E.S.P E.S.P. GMBH INC KZN LLC LP LTD LT NV PLC PTY S.A S.A. SAS UK USA").split()

# How energy units are written.
UNIT_ALIASES = {
    "KWH": "KWH",
    "KW H": "KWH",
    "KW-H": "KWH",
    "KILOWATT HOUR": "KWH",
    "KILOWATT HOURS": "KWH",
    "MWH": "MWH",
    "MW H": "MWH",
    "MW-H": "MWH",
    "MEGAWATT HOUR": "MWH",
    "MEGAWATT HOURS": "MWH",
    "TON": "TON",
    "TONS": "TON",
    "RTH": "RTH",
}

# Marks of UTF-8 read as windows-1252, and the 27 characters that code page has in place of controls.
MOJIBAKE = "[ÃÂâð�]"
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def own_columns(df: DataFrame) -> list[str]:
    """df's columns; names that begin like an operator's own helper columns are refused."""
    taken = [c for c in df.columns if c.startswith("_tw_")]
    if taken:
        raise ValueError(f"column names beginning with _tw_ are reserved: {', '.join(taken)}")
    return df.columns


def is_blank(c: Column) -> Column:
    """Null, empty or white space; c is read once."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nullif_blank(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def first_present(*cs: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*(nullif_blank(c) for c in cs))


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def lookup_text(c: Column) -> Column:
    """Lower case, squeezed."""
    return F.lower(squeeze(c))


def facility_key(c: Column) -> Column:
    """A place's name without case, marks and spacing; letters of any script stay."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "_", " "), "[.'`]", "")
    return trimmed(F.regexp_replace(plain, r"(?U)[^\w]+|_+", " "))


def base_clean(c: Column) -> Column:
    """Dashes and underscores to blanks, spacing squeezed, edge characters dropped."""
    spaced = F.regexp_replace(F.regexp_replace(c, "[-_]+", " "), r"(?U)\s+", " ")
    edge = "[" + "".join("\\" + e for e in EDGES if e != " ") + " ]+"
    return F.regexp_replace(spaced, f"^{edge}|{edge}$", "")


def proper_case(c: Column) -> Column:
    """Words with one capital; known short forms and dotted words all in capitals."""
    known = F.array(*(F.lit(x) for x in CAPITALS))

    def word(w: Column) -> Column:
        loud = F.array_contains(known, F.upper(w)) | w.contains(".")
        return F.when(loud, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))

    return F.array_join(F.transform(F.split(base_clean(c), " "), word), " ")


def upper_clean(c: Column) -> Column:
    return F.upper(base_clean(c))


def energy_unit(c: Column) -> Column:
    """The one energy unit a text names: KWH, MWH, TON or RTH; empty for none, for several, and for rates; null for null."""
    names = "|".join(sorted((a.replace(" ", r"\s?").replace("-", r"\-") for a in UNIT_ALIASES), key=len, reverse=True))
    upper = F.upper(base_clean(c))
    rate = upper.rlike(rf"/\s*(?<![A-Z0-9])(?:{names})(?![A-Z0-9])|(?<![A-Z0-9])(?:{names})(?![A-Z0-9])\s*(?:/|PER )")
    found = F.regexp_extract_all(F.regexp_replace(upper, r"[^A-Z0-9]+", " "), F.lit(rf"(?<![A-Z0-9])({names})(?![A-Z0-9])"), F.lit(1))
    bare = {a.replace(" ", "").replace("-", ""): u for a, u in UNIT_ALIASES.items()}
    aliases = F.create_map(*(F.lit(x) for kv in bare.items() for x in kv))
    units = F.array_distinct(F.transform(found, lambda u: F.element_at(aliases, F.regexp_replace(u, " ", ""))))
    return F.when(c.isNull(), None).when(~rate & (F.size(units) == 1), units[0]).otherwise("")


def _repaired_once(c: Column) -> Column:
    plain = F.translate(c, CP1252, CP1252_BYTES)
    fits = ~plain.rlike(r"[^\x{00}-\x{ff}]") & ~c.rlike(r"[\x{80}-\x{9f}]")
    raw = F.when(fits, F.encode(F.when(fits, plain).otherwise(""), "ISO-8859-1"))
    text = F.try_validate_utf8(raw.cast("string"))
    fewer = F.regexp_count(text, F.lit(MOJIBAKE)) < F.regexp_count(c, F.lit(MOJIBAKE))
    return F.when(c.rlike(MOJIBAKE) & text.isNotNull() & fewer, text).otherwise(c)


def mojibake_repaired(c: Column) -> Column:
    """UTF-8 that was read as windows-1252 put right, up to three times, as long as each pass leaves fewer marks of it."""
    for _ in range(3):
        c = F.get(F.transform(F.array(c), _repaired_once), F.lit(0))  # binds c, which a pass reads many times
    return c


def line_key(c: Column) -> Column:
    """A trimmed line id, without the .0 of a number read as a float."""
    return F.regexp_replace(trimmed(c), r"^(\d+)\.0+$", "$1")


def lookup_key(*cs: Column) -> Column:
    """Trimmed lower-case parts joined by underscores; blank parts stay empty."""
    return F.lower(F.concat_ws("_", *(F.coalesce(trimmed(c.cast("string")), F.lit("")) for c in cs)))


def issue_id(*cs: Column) -> Column:
    """Parts joined by underscores, all but letters and digits replaced, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.concat_ws("_", *cs), r"(?U)[^\p{Alnum}]", "_"), "^_+|_+$", "")


def safe_link(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?:"), F.lit(False))


# Fixed value: what stands in place of a link that cannot be opened.
NO_LINK = "SharePoint link unavailable"


def source_label(c: Column) -> Column:
    """A link that can be opened, else NO_LINK."""
    return F.when(safe_link(c), c).otherwise(NO_LINK)


def contains_any(term: str, *cs: Column) -> Column:
    """Whether any column contains a text, without case; a separator keeps it from spanning two columns."""
    return F.lower(F.concat_ws("\u0001", *cs)).contains(term.lower())


def holds_all(filters: dict[str, str]) -> Column:
    """Whether each column contains its text, without case and ends; a blank text asks for nothing, and a null value contains none."""
    asked = {c: term.strip().lower() for c, term in filters.items() if term.strip()}
    return reduce(lambda a, b: a & b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False)) for c, t in asked.items()), F.lit(True))
