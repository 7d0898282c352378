"""String, array and JSON functions, as expressions on columns (no Python at run time unless said so)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"
NOT_TOKEN = r"[^\p{L}\p{N}]+"
#: Scripts that are written without spaces between words, by their ranges: Kana, Han.
UNSPACED = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


def collapse(c: Column) -> Column:
    """White space (Unicode) to single spaces, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def capped(c: Column, limit: int, mark: str = "…") -> Column:
    """Null is empty; a longer text is cut to ``limit`` characters and marked."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def first_present(*cs: Column) -> Column:
    """The first that is neither null nor empty, as a string; else empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit(""))


def blank(c: Column) -> Column:
    """Null, white space, or the word NULL in any case."""
    return c.isNull() | F.upper(F.trim(c)).isin("", "NULL")


def display(limit: int, *cs: Column) -> Column:
    """The first that is not blank, cut and trimmed; else empty."""
    shown = F.coalesce(*[F.when(~blank(c), c) for c in cs])
    return F.trim(capped(shown, limit))


def title_of(content: Column, default: str = "untitled", width: int = 40) -> Column:
    short = F.trim(F.substring(collapse(content), 1, width))
    return F.when(short == "", F.lit(default)).otherwise(short)


def cut_values(m: Column, limit: int = 500) -> Column:
    """A map's string values cut to ``limit`` characters."""
    return F.transform_values(m, lambda _, v: F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit), F.lit("…"))).otherwise(v))


# What an error text must not give away, and what stands for it; at most 500 characters are kept.
REDACTIONS = [
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b", "<host>"),
    (r"(?i)\b(password|passwd|pwd)\b\s*[=:]\s*\S+", "$1=<redacted>"),
    (r"\b[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+(?:#[A-Za-z0-9_.\-]+)?", "<account>"),
]
ERROR_CHARS = 500


def redact(c: Column) -> Column:
    for pattern, put in REDACTIONS:
        c = F.regexp_replace(c, pattern, put)
    return F.substring(c, 1, ERROR_CHARS)


# ---- document metadata ----
# Words of the documents by which a compatibility mode is told, in order.
MODES = [("Oracle", "（Oracle 模式）|Oracle 租户|Oracle 模式"), ("MySQL", "（MySQL 模式）|MySQL 租户|MySQL 模式"), ("sys", "sys 租户|系统租户")]
NAV_SECTION = "相关(文档|阅读|链接|内容|问题)|参考(文档|资料|信息)|更多(信息|内容)|参见|延伸阅读|附录"
NAV_FILES = ("index.md", "readme.md")


def mode_of(c: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(MODES):
        out = F.when(F.coalesce(c, F.lit("")).rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return out


def canonical_mode(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "mysql", "MySQL").when(low == "oracle", "Oracle").when(low == "sys", "sys").otherwise(F.trim(c))


def version_of(*cs: Column) -> Column:
    """From the first text that names a version such as V4.2.1."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"[Vv](\d+\.\d+(?:\.\d+)*)", 1), F.lit("")) for c in cs], F.lit(""))


def clean_title(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def clean_keywords(c: Column, noise: tuple[str, ...]) -> Column:
    """Comma-separated (ASCII or full width), trimmed, without noise words, joined by spaces."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，]"), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: (x != "") & ~x.isin(*noise)), " ")


def frontmatter(c: Column) -> Column:
    """map of lower-cased keys from a leading --- block; empty without one."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*\n", 1)
    pairs = F.transform(
        F.filter(F.split(block, r"\r?\n"), lambda s: F.contains(s, F.lit(":"))),
        lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"), F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("v")),
    )
    # the last of equal keys counts
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(unique)


def body_of(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A---[^\S\n]*\n.*?\n---[^\S\n]*\n", "")


def nav_section(c: Column) -> Column:
    return F.substring_index(c, " > ", -1).rlike(NAV_SECTION)


def nav_file(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).isin(*NAV_FILES)


# ---- index texts ----
# How often title and keywords are repeated in the indexed text.
TITLE_REPEAT, KEYWORD_REPEAT = 5, 2


def _joined(parts: list[Column], sep: str) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), sep)


def composite_title(*parts: Column) -> Column:
    return _joined(list(parts), " ")


def weighted_text(title: Column, keywords: Column, section: Column, body: Column) -> Column:
    """Title and keywords repeated, section, then `` | `` and the body."""
    head = _joined([title] * TITLE_REPEAT + [keywords] * KEYWORD_REPEAT + [section], " ")
    return F.concat_ws(" | ", head, body)


def canonical_text(title: Column, keywords: Column, section: Column, body: Column) -> Column:
    return F.concat_ws(" | ", _joined([title, keywords, section], " "), body)


def byte_cut(c: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, ``…`` at the end of a cut text, no character split; limit 0 turns it off.

    The cut is taken from the bytes; the bytes of a split character are dropped."""
    if limit <= 0:
        return c
    room = max(0, limit - 3)
    raw = F.encode(c, "UTF-8")
    # a continuation byte has the top bits 10: the cut moves back to a character's first byte
    at = lambda k: F.conv(F.hex(F.substring(raw, room + 1 - k, 1)), 16, 10).cast("int")
    back = F.lit(3)
    for k in (2, 1, 0):
        back = F.when((at(k) < 128) | (at(k) >= 192), F.lit(k)).otherwise(back)
    head = F.decode(F.substring(raw, F.lit(1), F.lit(room) - back), "UTF-8")
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(head, F.lit("…")))


def content_hash(canonical: Column, text: Column) -> Column:
    """Two halves of 16 hex digits: of the canonical text (tells whether to embed again) and of the weighted one."""
    return F.concat(F.substring(F.sha2(canonical, 256), 1, 16), F.substring(F.sha2(text, 256), 1, 16))


def chunk_key(path: Column, section: Column, seq: Column) -> Column:
    """A stable non-negative 63-bit key of path, section and running number."""
    return F.xxhash64(F.concat_ws("#", path, section, seq.cast("string"))).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


# ---- queries ----
def plain_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, cut where Han, Hiragana or Katakana begin or end."""
    plain = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_TOKEN), lambda x: x != "")
    return F.flatten(F.transform(plain, lambda x: F.regexp_extract_all(x, F.lit(f"[{UNSPACED}]+|[^{UNSPACED}]+"), F.lit(0))))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; runs of Han, Hiragana and Katakana as overlapping pairs of characters (one alone as itself)."""
    text = F.lower(F.coalesce(c, F.lit("")))
    plain = F.filter(F.split(text, NOT_TOKEN), lambda x: x != "")
    runs = plain_tokens(c)
    pairs = lambda x: F.when(
        x.rlike(f"^[{UNSPACED}]") & (F.length(x) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    ).otherwise(F.array(x))
    # such a character has three bytes at least
    return F.when((F.octet_length(text) >= F.length(text) + 2) & text.rlike(f"[{UNSPACED}]"), F.flatten(F.transform(runs, pairs))).otherwise(plain)


def counts(tokens: Column) -> Column:
    """The distinct tokens and how often each stands in the array: an array of (term, tf)."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(s):
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(new, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tf"))))

    return let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,tf:int>>")))


def query_terms(c: Column) -> Column:
    """Distinct tokens, without single ASCII characters."""
    return F.array_distinct(F.filter(tokens(c), lambda x: ~x.rlike(r"^[\x00-\x7F]$")))


def excerpt(body: Column, terms: Column, width: int = 220) -> Column:
    """A window of collapsed text about the earliest term; without a hit the head."""
    text = collapse(body)
    hits = F.filter(F.transform(terms, lambda t: F.call_function("instr", F.lower(text), F.lower(t))), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits), F.lit(1)) - 1
    begin = F.greatest(F.lit(0), first - width // 3)
    begin = F.when(F.size(hits) > 0, begin).otherwise(F.lit(0))
    part = F.trim(F.substring(text, begin + 1, F.lit(width)))
    return F.concat(F.when(begin > 0, "…").otherwise(""), part, F.when(begin + width < F.length(text), "…").otherwise(""))


def passage(title: Column, section: Column, body: Column, limit: int) -> Column:
    """``title > section``, a line break, the collapsed body; cut."""
    head, text = _joined([title, section], " > "), collapse(body)
    out = F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)
    return F.substring(out, 1, limit) if limit > 0 else out


def path_label(parts: Column) -> Column:
    """Steps joined by `` > ``; of more than four the first, an ellipsis and the last two."""
    short = F.concat(F.slice(parts, 1, 1), F.array(F.lit("…")), F.slice(parts, -2, 2))
    return F.array_join(F.when(F.size(parts) > 4, short).otherwise(parts), " > ")


# Numbers that a plan node's property names.
PROPERTY_NUMBERS = ("table_rows", "physical_range_rows", "logical_range_rows", "index_back_rows", "output_rows", "is_index_back", "use_das")


def property_numbers(c: Column) -> Column:
    return F.struct(*[F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)\b{n}\s*:\s*(\d+)", 1), F.lit("")).cast("bigint").alias(n) for n in PROPERTY_NUMBERS])


def index_list(c: Column, name: str = "avail?able_index_name|avaiable_index_name") -> Column:
    """The comma-separated list in ``name[...]``; null if it is not there."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)(?:{name})\s*\[([^\]]*)\]"), F.lit(1))
    return F.when(F.size(found) > 0, F.filter(F.transform(F.split(F.get(found, F.lit(0)), ","), lambda x: F.trim(x)), lambda x: x != ""))


def sse_frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def frame_payload(frame: Column) -> Column:
    """Payload of one frame: its data lines joined by line breaks; comments are left out, and without data it is null."""
    data = F.filter(F.split(frame, "\n"), lambda s: F.startswith(s, F.lit("data:")))
    return F.when(F.size(data) > 0, F.array_join(F.transform(data, lambda s: F.regexp_replace(s, "^data: ?", "")), "\n"))


def sse_events(stream: Column) -> Column:
    """Payloads of the frames of a text."""
    frames = F.split(F.regexp_replace(stream, r"\r\n", "\n"), "\n\n")
    return F.filter(F.transform(frames, frame_payload), lambda p: p.isNotNull())


def thousands(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), "—").otherwise(F.format_number(c, 0))


def percent(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), "—").otherwise(F.concat(F.format_string("%.1f", c.cast("double") * 100), F.lit("%")))
