"""Text and Markdown operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text at every kind of line end; an end behind the last line begins no other."""
    parts = F.split(text, r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def markdown_document(text: Column) -> Column:
    """Content, lines, headings, code, links and images of a Markdown text."""
    return F.struct(text.alias("content"), lines(text).alias("lines"), headings(text).alias("headings"), code_blocks(text).alias("code_blocks"), links(text).alias("links"), images(text).alias("images"))


def _matches(text: Column, pattern: str, names: tuple[str, ...]) -> Column:
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    return F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names, strict=True)])


def headings(text: Column) -> Column:
    """ATX headings (T4) as structs of level and text."""
    zipped = _matches(text, r"(?md)^(#{1,6})\s+(.+)$", ("marks", "title"))
    return F.transform(zipped, lambda x: F.struct(F.length(x["marks"]).alias("level"), x["title"].alias("text")))


def code_blocks(text: Column) -> Column:
    """Fenced code (T5) as structs of lang (``text`` if none) and code."""
    zipped = _matches(text, "(?sU)```(\\w*)\n(.*?)```", ("lang", "code"))
    return F.transform(zipped, lambda x: F.struct(F.when(x["lang"] == "", "text").otherwise(x["lang"]).alias("lang"), x["code"].alias("code")))


def links(text: Column) -> Column:
    """Links that are not images."""
    return _matches(text, r"(?<!!)\[([^\]]+)\]\(([^)]+)\)", ("text", "url"))


def images(text: Column) -> Column:
    """Image references."""
    return _matches(text, r"!\[([^\]]*)\]\(([^)]+)\)", ("alt", "url"))


def plain_text(text: Column) -> Column:
    """Markdown without its marks."""
    for pattern, by in (
        ("(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?md)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), ("__([^_]+)__", "$1"), ("_([^_]+)_", "$1"),
        (r"(?md)^[-*_]{3,}$", ""), ("\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


def punctuation_spacing(text: Column) -> Column:
    """No blank before closing or after opening marks; broken ligatures joined."""
    for pattern, by in ((r"(?<=\p{L}) (f) f i(?=\p{L})", "$1fi"), (r"(?<=\p{L}) (f) f l(?=\p{L})", "$1fl"), (r"(?<=\p{L}) (f) f (?=\p{L})", "$1f"), (r"(?<=\p{L}) (f) ([il])(?=\p{L})", "$1$2")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(F.regexp_replace(text, r"\s+([,.!?;:)\]}])", "$1"), r"\s*·\s*", "·")


def layout_clean(text: Column) -> Column:
    """Ligature placeholders resolved, control characters but line feed and tab dropped."""
    text = F.replace(F.replace(text, F.lit("\x00f\x00"), F.lit("fi")), F.lit("\x00l\x00"), F.lit("fl"))
    return F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")


def doc_clean(text: Column) -> Column:
    """Control characters of binary word documents."""
    return F.regexp_replace(F.translate(text, "\x07\x0b\x0c\x0e", "\t\n\n\n"), r"[\x00-\x08\x0f-\x1f]", "")


def ppt_clean(text: Column) -> Column:
    """Control characters of binary slides."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "\t\x0b", " \n"), r"[\x00-\x09\x0c-\x1f]", ""), r"^\s+|\s+$", "")


def letters_to_column(letters: Column) -> Column:
    """A sheet column's letters to its number, from 1."""
    codes = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a * 26 + F.ascii(c) - 64)


def column_to_letters(number: Column) -> Column:
    """A sheet column's number, up to 18278, to its letters."""
    def letter(n: Column) -> Column:
        return F.char(65 + n)

    n = number - 1
    two, three = n - 26, n - 702
    return (
        F.when(number <= 26, letter(n))
        .when(number <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def text_width(text: Column, size: Column) -> Column:
    """The estimated width of a text: CJK characters 0.9, others 0.45 of the font size."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda w, c: w + size * F.when(F.ascii(c) > 0x2E7F, 0.9).otherwise(0.45))


#: Media types by extension.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
    "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf",
}


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def image_kind(data: Column) -> Column:
    """Image format by magic bytes."""
    def starts(prefix: str) -> Column:
        return F.substring(F.hex(data), 1, len(prefix)) == prefix

    return F.when(starts("89504E47"), "png").when(starts("FFD8FF"), "jpg").when(starts("47494638"), "gif").when(starts("424D"), "bmp").when(starts("49492A00") | starts("4D4D002A"), "tiff")
