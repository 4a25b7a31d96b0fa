"""Scalar text functions of function lists, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How letters are written without marks, and what counts as one.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "ae"), ("Ö", "oe"), ("Ü", "ue"))
RAISED, DIGITS = "¹²³⁴⁵⁶⁷⁸⁹⁰", "1234567890"


def _decomposed() -> tuple[str, str]:
    """The characters whose compatibility form begins with a plain letter or digit and goes on with combining marks
    only, and those letters: a table that follows from the Unicode data, for translate()."""
    import unicodedata

    found = []
    for c in map(chr, range(0xA0, 0x2E80)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1 and plain.isascii() and plain.isalnum():
            found.append((c, plain))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


ACCENTED, PLAIN = _decomposed()
#: Compatibility forms of several letters.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("№", "no"), ("½", "1 2"), ("¼", "1 4"), ("¾", "3 4"))
MARKS = ("x", "X", "✓", "✔", "*", "•")
EDGES = " \t:;,.-–—/|*()[]"
FOCUS = r"(?i)(?<![A-Za-zÄÖÜäöüß0-9])(asp|isp|automationsschwerpunkt|informationsschwerpunkt)[\s.:;,_\-–/#]*(?:nr\.?|no\.?)?[\s.:;,_\-–/#]*(\d{1,3})?(?![A-Za-z0-9])"
UNASSIGNED = "ohne Zuordnung"


def present(x: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(x, F.lit(""))


def normalize(text: Column) -> Column:
    """Lower case, umlauts written out, accents and other signs gone, single spaces. Null becomes ''. Texts of plain letters,
    as most are, at least with their umlauts written out, skip the steps that change none of their letters."""
    x = F.coalesce(text, F.lit(""))
    spaced = lambda y: F.btrim(F.regexp_replace(y, "[^a-z0-9]+", " "))
    ascii_ = lambda y: F.octet_length(y) == F.char_length(y)
    written_out = x
    for a, b in UMLAUTS:
        written_out = F.replace(written_out, F.lit(a), F.lit(b))
    full = written_out
    for a, b in LIGATURES:
        full = F.replace(full, F.lit(a), F.lit(b))
    # marks that stand by themselves go with their letter
    full = F.lower(F.translate(F.regexp_replace(full, r"\p{M}+", ""), RAISED + ACCENTED, DIGITS + PLAIN))
    return F.when(ascii_(x), spaced(F.lower(x))).when(ascii_(written_out), spaced(F.lower(written_out))).otherwise(spaced(full))


def parse_count(text: Column) -> Column:
    """A cell's count: a number, 1 for a mark, null for anything else."""
    x = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(x.isin(*MARKS), 1.0).when(x.rlike(r"^\d+([.,]\d+)?$"), F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def natural_number(text: Column) -> Column:
    """What try_cast to int gives from 0 on, null for anything else. A failing cast throws within, some 13 us each, so only
    texts that look like such a number are cast."""
    return F.when(text.rlike(r"^[\x00-\x20\x7F]*(\+?[0-9]+|-0+)[\x00-\x20\x7F]*$"), text.try_cast("int"))


def is_freetext(text: Column) -> Column:
    return F.coalesce((F.regexp_replace(text, r"(?U)\s", "") != "") & parse_count(text).isNull(), F.lit(False))


def footnote_markers(text: Column) -> Column:
    raised = F.transform(F.regexp_extract_all(text, F.lit("([¹²³⁴⁵⁶⁷⁸⁹⁰])"), F.lit(1)), lambda x: F.translate(x, RAISED, DIGITS))
    plain = F.regexp_extract_all(text, F.lit(r"(?<![\d,.])(\d{1,2})\s*\)"), F.lit(1))
    return F.array_distinct(F.concat(raised, plain))


def normalize_address(address: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.replace(F.coalesce(address, F.lit("")), F.lit(","), F.lit(".")), r"\s", ""), r"\."), lambda p: p != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^\d+$"))
    return F.when(good, F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), ".")).otherwise("")


def join_address(section: Column, column_no: Column) -> Column:
    return F.concat_ws(".", present(normalize_address(section)), present(normalize_address(column_no)))


def repair_glyphs(text: Column) -> Column:
    """Control characters of a defective font stand 29 code points too low."""
    return F.translate(text, "".join(map(chr, range(1, 32))), "".join(chr(c + 29) for c in range(1, 32)))


def clean_label(text: Column, most: int = 60) -> Column:
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.btrim(F.substring(F.btrim(x, F.lit(EDGES)), 1, most), F.lit(EDGES))


def parse_focus(text: Column) -> Column:
    """struct(code, label), or null: the first focus with a number, else the first. The label is what follows it, else
    what stands before it after the last colon."""
    pieces, found = F.split(text, FOCUS, -1), F.regexp_extract_all(text, F.lit(FOCUS), F.lit(0))
    kinds, numbers = F.regexp_extract_all(text, F.lit(FOCUS), F.lit(1)), F.regexp_extract_all(text, F.lit(FOCUS), F.lit(2))
    n = F.greatest(F.coalesce(F.array_position(F.transform(numbers, lambda x: x != ""), True), F.lit(0)), F.lit(1)).cast("int")
    number = F.try_element_at(numbers, n)
    code = F.concat(F.when(F.lower(F.substring(F.try_element_at(kinds, n), 1, 1)) == "a", "ASP").otherwise("ISP"), F.when(number != "", F.lpad(number.cast("int").cast("string"), F.greatest(F.lit(2), F.length(number.cast("int").cast("string"))), F.lit("0"))).otherwise(""))
    # pieces and finds alternate
    after = F.concat_ws("", F.flatten(F.transform(F.sequence(n, F.size(found)), lambda i: F.array(F.when(i == n, F.lit("")).otherwise(F.try_element_at(found, i)), F.try_element_at(pieces, i + 1)))))
    before = F.concat_ws("", F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.array(F.try_element_at(pieces, i), F.when(i < n, F.try_element_at(found, i)).otherwise(F.lit(""))))))
    label = F.coalesce(present(clean_label(after)), clean_label(F.substring_index(before, ":", -1)))
    return F.when(F.size(found) > 0, F.struct(code.alias("code"), label.alias("label")))


def german_number(value: Column, digits: int = 2) -> Column:
    return F.translate(F.format_number(value, digits), ",.", ".,")


def bbox(text: Column) -> Column:
    """struct(x0, y0, x1, y1) of four numbers, else null."""
    x = F.transform(F.split(text, ","), lambda p: F.btrim(p).try_cast("double"))
    return F.when((F.size(x) == 4) & F.forall(x, lambda p: p.isNotNull()), F.struct(*[x[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def slug(text: Column) -> Column:
    """A name for a folder: words, spaces, dots and dashes; spaces become one _; 80 characters; `Projekt` if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s.-]", ""), r"(?U)^\s+|\s+$", "")
    return F.coalesce(present(F.substring(F.regexp_replace(x, r"(?U)\s+", "_"), 1, 80)), F.lit("Projekt"))


def contains_keyword(text: Column, word: Column) -> Column:
    return F.contains(normalize(text), normalize(word))


def bbox_text(box: Column) -> Column:
    """The text of struct(x0, y0, x1, y1) with two places; null for none."""
    return F.when(box.isNotNull(), F.concat_ws(",", *[F.format_string("%.2f", box[n].cast("double")) for n in ("x0", "y0", "x1", "y1")]))


@F.pandas_udf(StringType())
def general_number(x: pd.Series) -> pd.Series:
    """A number in six significant digits without needless places, as C prints it with %g: rounded by its exact binary
    value, which no built-in function does. For the few numbers in a report's lines."""
    return x.map("{:g}".format, na_action="ignore")


def clean_ocr_label(text: Column) -> Column:
    """A label without remains of lines: their signs, and a single small letter before the label (after its number)."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[|\\\[\]{}_~^`]+", " ")
    x = F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" .,:;-"))
    x = F.regexp_replace(x, "^(\\d{1,3}\\s+)?[a-zäöü](?=[A-ZÄÖÜ])", "$1")
    return F.btrim(F.regexp_replace(x, "^(\\d{1,3}\\s+)?[a-zäöü]\\s+(?=\\S)", "$1"))


def section_of(address: Column) -> Column:
    """An address without its last part; itself if it has one part only."""
    return F.coalesce(present(F.regexp_extract(address, r"^(.*)\.[^.]*$", 1)), address)


def column_letters(index: Column) -> Column:
    """A, B, .. Z, AA, .. of a column's number from 0 (below 18,278; above, the first letter goes on with the code points
    after Z)."""
    n = index.cast("int")
    letter = lambda k: F.decode(F.unhex(F.lpad(F.hex((65 + k).cast("long")), 8, F.lit("0"))), "UTF-32")  # noqa: E731  chr() ends at 255
    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26).cast("int")), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676).cast("int")), letter(F.floor(three % 676 / 26).cast("int")), letter(three % 26)))
    )


def leading_number(label: Column) -> Column:
    """struct(number, rest): a row number of up to three digits before the label."""
    return F.struct(F.regexp_extract(label, r"^(\d{1,3})(?: (.*))?$", 1).alias("number"), F.when(label.rlike(r"^\d{1,3}( |$)"), F.regexp_extract(label, r"^(\d{1,3})(?: (.*))?$", 2)).otherwise(label).alias("rest"))
