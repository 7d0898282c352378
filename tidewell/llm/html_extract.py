"""HTML extraction by equivalence-class template deduction.

A page is a row of tokens: its block-level elements, each named by its path of tags with class and id, and its stretches of
text, inside article elements too, each named by path and words.  For every host, the tokens' occurrence vectors over its pages are summed into
signatures (a hash of page and count, added up, so vectors are never gathered); tokens with one signature are an
equivalence class.  The class with one occurrence on every page is valid at the root of the template.  Of the others, tokens
that stand in one gap between the root's tokens, always the same, are a class of their own; it is valid if it has two tokens or more,
an element among them, is on a third of the pages at least, and its tokens take turns in one order on all of them.
Text of valid classes is the template's own and is dropped wherever it stands; what stands between the tokens of the template
is its slots, and what they hold is their text without the template's.
Equal pages of a host count once, and a token counts only if it stands on ``PAGES`` pages, so copies of one page are no template.
Slots inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments, told by their elements'
names and roles and by classes and ids that are made of words for such parts alone, are none of the article; a form that holds most of a page is the page.  A page's article and main elements are one slot, set against the host's
others: if, over the pages that have them, one template element beside them holds more than they do, that element is the
article (the innermost with ``MASS`` of the largest), else they are.  A page without any of these
takes that template element which holds most of the host's free text (at least ``MASS`` of it, the innermost), or else all of its slots.  A host of fewer than ``PAGES`` pages has no vectors to compare and gives its elements alone.

Defined results: null or empty html gives empty text; a null or odd url is a host of its own kind; rows that share a
page_id are pages of their own; an empty table gives an empty result; other columns are left aside."""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

PAGES, MASS = 4, 0.6
PAGE = 0
#: Numbers in all templates up to which they are sent to every executor; beyond it pages and templates are shuffled by host.
BROADCAST = 2_000_000
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template textarea iframe svg math object".split())
NOT_ARTICLE = frozenset("head nav footer aside form menu dialog button select option".split())
SECTION = frozenset("article main".split())
#: Elements that are one paragraph, heading or cell: no slot for an article, whose other paragraphs stand beside them.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre caption figcaption summary address".split())
CLOSES = {"li": frozenset(["li"]), "p": frozenset(["p"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
ROLES = frozenset("navigation banner contentinfo complementary search menu dialog alert form".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion
    nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar
    comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar""".split()
)
#: What may stand beside these words in a class or id that is still a part's name and not a title's.
LAYOUT = frozenset(
    """area bar block body bottom box button buttons col column container fixed form global group header holder inline inner item items left link links list
    main module outer page panel post posts primary right row secondary section site slot sticky text title top unit wrap wrapper zone""".split()
)


class Block:
    __slots__ = ("text", "path", "named", "own", "free", "place")

    def __init__(self, text, path, named, own, free, place):
        self.text, self.path, self.named, self.own, self.free, self.place = text, path, named, own, free, place


#: Whether an element is none of the article: a form may be (pages lie in one as a whole), another part is not.
FREE, FORM, AWAY = 0, 1, 2


def _part(value: str) -> bool:
    """Whether a class or id has a name made of words for a part of a page alone; `related-work` or `social-history` are of a text."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in WORDS for w in words) and all(w in WORDS or w in LAYOUT for w in words):
            return True
    return False


def _away(name: str, attrs: str, inside: bool) -> int:
    """Whether an element is none of the article by its name, role, class or id; classes and ids of headings, paragraphs and cells, often made
    from their text, say nothing."""
    if name == "form":
        return FORM
    if name in NOT_ARTICLE or name == "header" and not inside:
        return AWAY
    if not attrs:
        return FREE
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in ROLES or key in ("hidden", "aria-hidden") and value == "true":
            return AWAY
        if key in ("class", "id") and name not in LEAF and name not in ("html", "body", "article", "main") and _part(value):
            return AWAY
    return FREE


def parse(page: str) -> tuple[list[Block], dict[str, list[int]]]:
    """Blocks of text in order, and where each element path occurs: positions count elements and blocks together.

    A block knows its path, the element paths around it, the article or main element it lies in (by number, -1 for none),
    and whether it is free of what is none of an article."""
    blocks: list[Block] = []
    paths: dict[str, list[int]] = defaultdict(list)
    place = 0
    # open elements: name, path, away, section, inline
    stack: list[tuple[str, str, int, int, bool]] = [("", "", FREE, -1, False)]
    held: list[str] = []
    sections, end, at = 0, len(page), 0

    def flush():
        nonlocal place
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                around = [p for _, p, _, _, inline in stack if not inline]
                _, path, away, own, _ = stack[-1]
                blocks.append(Block(text, path, around, own, away, place))
                place += 1

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, attrs, closing = name.lower(), m[3] if m[2] else m[6], m[1] or m[4]
        inline = name in INLINE
        if not inline:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if not inline or all(s[4] for s in stack[k:]):
                        del stack[k:]
                    break
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name in ("script", "style"):
                shut = re.compile(f"</{name}[^>]*(?:>|$)", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        if name in VOID:
            continue
        if shuts := CLOSES.get(name):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shuts:
                    del stack[k:]
                    break
                if not stack[k][4] and stack[k][0] not in ("td", "th", "tr"):
                    break
        _, path, away, own, _ = stack[-1]
        if inline:
            stack.append((name, path, max(away, _away(name, attrs, own >= 0)) if attrs else away, own, True))
            continue
        marks = ".".join(sorted(v.strip("\"'") for k, v in _ATTR.findall(attrs) if k.lower() in ("class", "id"))) if attrs and "=" in attrs else ""
        path = f"{path}/{name}.{marks}" if marks else f"{path}/{name}"
        if name in SECTION and away < AWAY:
            sections += 1
            own = sections if own < 0 or name == "article" else own
        paths[path].append(place)
        place += 1
        stack.append((name, path, max(away, _away(name, attrs, own >= 0)), own, False))
    flush()
    # a form that holds most of what is left of a page is the page, not a part of it
    mass = [sum(len(b.text) for b in blocks if b.free == k) for k in (FREE, FORM)]
    for b in blocks:
        b.free = b.free == FREE or b.free == FORM and mass[FORM] > mass[FREE]
    return blocks, paths


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def tag_token(path: str) -> int:
    return _signed(_hash("tag", path))


def text_token(b: Block) -> int:
    return _signed(_hash("text", b.path, b.text, f"{b.free:d}{b.own >= 0:d}"))


def tokens(blocks: list[Block], paths: dict[str, list[int]]) -> dict[int, tuple[list[int], tuple[int, int, int], list[int] | None]]:
    """Of each token of a page: where it occurs, its free text (in all, in article and main elements, beside them on a page
    that has them), and for a stretch of text the elements around it that can be slots.  The page itself is a token, ``PAGE``."""
    has = any(b.own >= 0 and b.free for b in blocks)
    keys = {p: tag_token(p) for p in paths}
    slots = {p for p in paths if p.rsplit("/", 1)[-1].split(".")[0] not in LEAF}
    out: dict[int, list] = {PAGE: [[-1], 0, 0, 0, None]} | {keys[p]: [at, 0, 0, 0, None] for p, at in paths.items()}
    for b in blocks:
        around = [PAGE, *dict.fromkeys(keys[p] for p in b.named if p in slots)]
        own = out.setdefault(text_token(b), [[], 0, 0, 0, around])
        own[0].append(b.place)
        if b.free:
            for s in (own, *(out[t] for t in around)):
                s[1] += len(b.text)
                s[2 if b.own >= 0 else 3] += len(b.text) if has else 0
    return {k: (at, (a, s, o), around) for k, (at, a, s, o, around) in out.items()}


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][-+.\w]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, page (its hash: equal pages of a host are one), places, mass, inside, beside, around (see ``tokens``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, rows = set(), []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _signed(_hash(page))
                if (name, own) in done:
                    continue
                done.add((name, own))
                rows += [(name, t, own, at, *masses, around) for t, (at, masses, around) in tokens(*parse(page)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    names = ["host", "token", "page", "places", "mass", "inside", "beside", "around"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 3, pa.list_(pa.int64())]
    whole = pages.select(host(F.col("url")).alias("host"), F.col("html").alias("page")).where("page is not null")
    got = whole.mapInArrow(run, "host string, token bigint, page bigint, places array<int>, mass bigint, inside bigint, beside bigint, around array<bigint>")
    return got.dropDuplicates(["host", "token", "page"])


def vectors(found: DataFrame) -> DataFrame:
    """host, token, pages (that have it), signature of its occurrence vector, total (occurrences), mass, inside, beside, around; tokens on ``PAGES`` pages or more."""
    # a text's elements follow from its path, so any row's are right
    summed = found.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", F.size("places")).cast("decimal(38,0)")).alias("signature"), F.count(F.lit(1)).alias("pages"), F.max("around").alias("around"),
        F.sum(F.size("places")).alias("total"), *[F.sum(c).alias(c) for c in ("mass", "inside", "beside")],
    )
    return summed.where(F.col("pages") >= PAGES)


def nested(found: DataFrame, v: DataFrame) -> DataFrame:
    """host, token of valid classes but the root's.  ``v``: vectors with _pages and _root of the host."""
    root = F.col("signature") == F.col("_root")
    share = v.where(root | (F.col("pages") * 3 >= F.col("_pages"))).select("host", "token", "signature", root.alias("root"), F.col("around").isNull().alias("element"))
    at = found.select("host", "token", "page", "places").join(share, ["host", "token"])
    roots = at.where("root").groupBy("host", "page").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("_roots"))
    others = at.where("not root").select("host", "page", "token", "signature", "element", F.explode("places").alias("place")).join(roots, ["host", "page"])
    others = others.withColumn("gap", F.size(F.filter("_roots", lambda r: r < F.col("place")))).drop("_roots")
    one = others.groupBy("host", "token").agg(F.min("gap").alias("gap"), F.max("gap").alias("_last"), F.min("signature").alias("signature"), F.first("element").alias("element")).where("gap = _last")
    size = one.groupBy("host", "signature", "gap").agg(F.count(F.lit(1)).alias("size"), F.max("element").alias("has")).where("size >= 2 and has")
    members = one.join(size, ["host", "signature", "gap"]).select("host", "token", "signature", "gap", "size")
    turns = others.select("host", "page", "token", "place").join(members, ["host", "token"]).groupBy("host", "signature", "gap", "page").agg(
        F.max("size").cast("int").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("said")
    )
    first = F.slice("said", F.lit(1), F.col("size"))
    same = F.col("said") == F.flatten(F.array_repeat(first, (F.size("said") / F.col("size")).cast("int")))
    ordered = turns.groupBy("host", "signature", "gap").agg(F.min(same).alias("same"), F.min(first).alias("a"), F.max(first).alias("b")).where("same and a = b")
    return members.join(ordered.select("host", "signature", "gap"), ["host", "signature", "gap"]).select("host", "token")


def templates(pages: DataFrame) -> DataFrame:
    """One row per host with ``PAGES`` different pages or more: drop (texts of valid classes), elements (root elements that hold
    MASS of the free text, the innermost first), rivals (template elements beside articles that hold more than these, likewise)."""
    found = stored(occurrences(pages))
    v = stored(vectors(found))
    # the vector of the page itself is that of the root class
    whole = v.where(F.col("token") == PAGE).select(F.col("host").alias("_host"), F.col("pages").alias("_pages"), F.col("signature").alias("_root"))
    v = v.join(whole, F.col("host") == F.col("_host"))
    inner_classes = nested(found, v).withColumn("_valid", F.lit(True))
    root = F.col("signature") == F.col("_root")
    valid = v.join(inner_classes, ["host", "token"], "left").where(root | F.col("_valid"))
    rows = stored(valid.select("host", root.alias("root"), "token", "around", (F.col("total") == F.col("pages")).alias("once"), "mass", "inside", "beside"))
    own = rows.where("around is not null").select(F.col("host").alias("_h"), F.explode("around").alias("_t"), "mass", "inside", "beside")
    own = own.groupBy("_h", "_t").agg(*[F.sum(c).alias(f"_{c}") for c in ("mass", "inside", "beside")])
    held = rows.join(own, (F.col("host") == F.col("_h")) & (F.col("token") == F.col("_t")), "left").select(
        "host", "root", "token", "once", (F.col("token") == PAGE).alias("page"), F.col("around").isNotNull().alias("text"), F.col("inside").alias("all_inside"),
        *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("mass", "inside", "beside")],
    )
    slot = lambda size, which: F.collect_list(F.when(~F.col("page") & ~F.col("text") & which & (F.col(size) > 0), F.struct(F.col(size).alias("mass"), "token")))
    got = held.groupBy("host").agg(
        F.sort_array(F.collect_set(F.when(F.col("text"), F.col("token")))).alias("drop"), F.max(F.when(F.col("page"), F.col("inside"))).alias("inside"),
        slot("mass", F.col("root")).alias("holders"), slot("beside", F.col("once") & (F.col("all_inside") == 0)).alias("others"),
    )
    most = lambda slots: F.array_max(F.transform(slots, lambda h: h["mass"]))
    inner = lambda slots: F.transform(F.array_sort(F.filter(slots, lambda h: h["mass"] >= most(slots) * MASS)), lambda h: h["token"])
    return got.select(
        F.col("host").alias("_host"), "drop", inner(F.col("holders")).alias("elements"),
        F.when(most(F.col("others")) > F.col("inside"), inner(F.col("others"))).otherwise(F.array().cast("array<bigint>")).alias("rivals"),
    )


def article(page: str, drop: frozenset[int] = frozenset(), elements: list[int] | tuple = (), rivals: list[int] | tuple = ()) -> str:
    blocks, _ = parse(page)
    blocks = [b for b in blocks if b.free]
    kept = [b for b in blocks if b.own >= 0]
    for e in rivals if kept else elements:
        inside = [b for b in blocks if any(tag_token(p) == e for p in b.named)]
        if inside:
            kept = inside
            break
    return "\n".join(b.text for b in kept or blocks if not drop or text_token(b) not in drop)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    template = stored(templates(pages))
    size = template.agg(F.sum(F.size("drop") + F.size("elements") + F.size("rivals") + 8)).first()[0] or 0
    if size <= BROADCAST:
        template = F.broadcast(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, drop, elements, rivals in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                out.append(article(page or "", frozenset(drop or ()), elements or (), rivals or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(template, F.col("host") == F.col("_host"), "left")
    return rows.select("page_id", "url", "html", "drop", "elements", "rivals").mapInArrow(run, "page_id bigint, url string, text string")


def op7(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: What the query gives on pages whose article element is whole and holds headings, paragraphs and inline markup alone.
SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p|br)>') AS parts FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
  FOR x IN parts] AS blocks FROM a)
SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text, length(array_to_string([x FOR x IN blocks IF x <> ''], chr(10)))::BIGINT AS n_chars FROM b
"""
