"""Main text of pages by wrapper induction.

A page's blocks form a tree; runs of like siblings are one node. Pages with the same tree on a host have one skeleton,
and a host's skeletons are aligned with its most frequent one by simple tree matching, so each block gets a slot of the
host's wrapper. A slot whose text stays the same, or changes among few values, over pages of different content is
template, and so is a line of a varying slot that half of the contents repeat; the rest of a varying slot is content,
inside an article and outside. Copies and near copies of a page on its host count as one content, so that they do not
make it a template. Blocks that say themselves what they are (menus, forms, adverts, comments and so on) are never
content; where a page has an article, a block outside it is content only if its slot was seen to vary.

Each page is parsed once; what is left of it, its lines with their slots, waits in the shared folder for the wrapper,
which a join brings to it. A host's pages are never in one group: each skeleton is aligned for itself with the model.

Defined results: null, empty or unparsable html gives an empty text; a page of a host with fewer than three different
contents is judged by its own blocks alone; null url is a host of its own; a page of any length is read whole; of equally
frequent skeletons the one of the smallest hash is the model; repeated rows are extracted each; columns of other names are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, release
from .simhash import components, shingle_hashes

#: Fewest different contents of a host by which a slot can be judged, and in which a text is seen before it is template.
LEAST = 3
#: A slot is template if one text has this share of contents, or if there are at most this many texts a content.
CONSTANT, FEW = 0.5, 1 / 3
#: A slot's verdict: seen in too few contents, template, or varying.
UNKNOWN, TEMPLATE, VARYING = 0, 1, 2
#: Pages of a host are one content if they agree in one of so many bands of so many least hashes of runs of five words:
#: 0.99 of the pairs alike by 0.8, 0.03 of those alike by 0.3.
RUN, BANDS, ROWS = 5, 12, 5
FACTORS = [xxhash.xxh64_intdigest(b"least", k) | 1 for k in range(BANDS * ROWS)]

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Fixed names from the HTML standard.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object audio video canvas".split())
OUT = frozenset("nav header footer aside form head button select menu search dialog".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption".split())
#: Words in class, id or role by which a block says that it is not content: as a name's first word, or as its last.
FIRST = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disqus gdpr menu nav navbar navigation newsletter notice pagination popup promo promotion recommended related replies respond share sharing signup social sponsor sponsored subscribe".split())
LAST = FIRST | frozenset("alert aside complementary dialog footer form header login masthead modal navigation overlay pager search sidebar side toolbar widget widgets".split())
#: Words behind them that change nothing, and words before them that speak of another block.
BEHIND = frozenset("area bar block box container content holder inner item items links list panel section slot unit wrap wrapper zone".split())
ABOUT = frozenset("has no with without is".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def not_content(value: str) -> bool:
    """Does a class, id or role name a block that is not content? `left-sidebar` does, `has-sidebar` and `sidebar-right` do not."""
    for name in value.split():
        parts = [p.lower() for p in NAME.findall(name)]
        if not parts or parts[0] in ABOUT:
            continue
        while len(parts) > 1 and parts[-1] in BEHIND:
            parts.pop()
        if parts[0] in FIRST or parts[-1] in LAST:
            return True
    return False


MAIN = re.compile(r"(?:^|\s)(?:main|articleBody)(?:$|\s)")


class Block:
    __slots__ = ("tag", "label", "out", "main", "parts", "slot")

    def __init__(self, tag: str, label: str = "", out: bool = False, main: bool = False):
        self.tag, self.label, self.out, self.main = tag, label or tag, out, main
        self.parts: list = []  # texts and blocks in page order
        self.slot = -1


def opened(tag: str, attrs: str) -> Block:
    kind, out, main = "", tag in OUT, tag in ("article", "main")
    if attrs.strip():
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                out = out or (tag != "body" and not_content(value))
                if name == "class" and not kind:
                    kind = re.sub(r"\d+", "", value.split()[0] if value.split() else "")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                out = True
            if name in ("role", "itemprop"):
                main = main or bool(MAIN.search(value))
    return Block(tag, f"{tag}.{kind}" if kind else tag, out, main and not out)


def parse(page: str) -> Block:
    """The tree of a page's blocks; inline elements leave only their text, raw elements nothing."""
    root = Block("html")
    stack = [root]
    at, n = 0, len(page)
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].parts.append(entities.unescape(text))
        if not m:
            return root
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not m.group(1):
            if not m.group(3).endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            stack[-1].parts.append(" ")
        elif tag == "br":
            stack[-1].parts.append(" ")
        elif tag == "html" or tag not in BLOCKS:
            continue
        elif m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        else:
            if tag == "body":
                del stack[1:]
            closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in closes or (stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in PROSE)):
                stack.pop()
            block = opened(tag, m.group(3))
            stack[-1].parts.append(block)
            if tag not in VOID:
                stack.append(block)


def own_text(block: Block) -> list[str]:
    """Texts of the block itself, cut where another block stands."""
    out, now = [], []
    for part in block.parts:
        if isinstance(part, str):
            now.append(part)
        else:
            out.append(" ".join("".join(now).split()))
            now = []
    out.append(" ".join("".join(now).split()))
    return [t for t in out if t]


def lines_in(block: Block, into: list[str]) -> list[str]:
    """Texts of the block and of the blocks in it that may be content."""
    into += own_text(block)
    for part in block.parts:
        if not isinstance(part, str) and not part.out:
            lines_in(part, into)
    return into


def skeleton(root: Block) -> list:
    """The tree with runs of like siblings as one node, [label, children]. Each block is told its node's number in preorder."""
    count = 0

    def node(blocks: list[Block]) -> list:
        nonlocal count
        for b in blocks:
            b.slot = count
        count += 1
        runs: list[list[Block]] = []
        for b in (p for x in blocks for p in x.parts if not isinstance(p, str)):
            if runs and runs[-1][0].label == b.label:
                runs[-1].append(b)
            else:
                runs.append([b])
        return [blocks[0].label, [node(r) for r in runs]]

    return node([root])


def match(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: the most nodes two trees have in common, order and ancestry kept, and the children's pairs."""
    if a[0] != b[0]:
        return 0, []
    rows, cols = len(a[1]), len(b[1])
    best = [[0] * (cols + 1) for _ in range(rows + 1)]
    inner = {}
    for i in range(rows):
        for j in range(cols):
            w = inner[i, j] = match(a[1][i], b[1][j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[0])
    i, j, pairs = rows, cols, []
    while i and j:
        w = inner[i - 1, j - 1]
        if w[0] and best[i][j] == best[i - 1][j - 1] + w[0]:
            pairs.append((i - 1, j - 1, w[1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[rows][cols] + 1, pairs


def numbered(tree: list, start: int = 0) -> tuple[list, int]:
    """[number in preorder, children] and the next number."""
    now, kids = start + 1, []
    for child in tree[1]:
        kid, now = numbered(child, now)
        kids.append(kid)
    return [start, kids], now


def align(tree: list, model: list) -> dict[int, int]:
    """Nodes of tree to nodes of model."""
    out: dict[int, int] = {}

    def walk(a, b, pairs):
        out[a[0]] = b[0]
        for i, j, more in pairs:
            walk(a[1][i], b[1][j], more)

    size, pairs = match(tree, model)
    if size:
        walk(numbered(tree)[0], numbered(model)[0], pairs)
    return out


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def signature(root: Block) -> tuple[int, list[int]]:
    """A page's content for counting: a hash of its lines, which copies share, and bands that near copies share."""
    text = " ".join(lines_in(root, []))
    runs = np.array(shingle_hashes(text.encode("utf-8", "surrogatepass").split(), RUN), np.uint64)
    if not len(runs):
        return hashed(text), []
    with np.errstate(over="ignore"):
        least = np.array([(runs * np.uint64(f)).min() for f in FACTORS], np.uint64).reshape(BANDS, ROWS)
    return hashed(text), [xxhash.xxh64_intdigest(row.tobytes(), k) >> 1 for k, row in enumerate(least)]


def parts_of(root: Block) -> list[tuple[int, bool, str]]:
    """(slot, inside of the article, line) of the blocks that may be content, in page order; without an article all is inside."""
    mains: list[Block] = []

    def find(b: Block) -> None:
        for p in b.parts:
            if isinstance(p, str) or p.out:
                continue
            if p.main:
                mains.append(p)
            else:
                find(p)

    find(root)
    out: list[tuple[int, bool, str]] = []

    def put(b: Block, inside: bool) -> None:
        inside = inside or b.main
        now: list[str] = []

        def end() -> None:
            line = " ".join("".join(now).split())
            now.clear()
            if line:
                out.append((b.slot, inside, line))

        for p in b.parts:
            if isinstance(p, str):
                now.append(p)
            else:
                end()
                if not p.out:
                    put(p, inside)
        end()

    put(root, not mains)
    return out


def chosen(parts: Column, verdict: Column, constant: Column) -> Column:
    """The lines that the wrapper lets pass, one below the other. By slot: its verdict, hashes of its template lines."""

    def content(p: Column) -> Column:
        says = F.coalesce(F.get(verdict, p["slot"]), F.lit(UNKNOWN))
        shown = (says != TEMPLATE) & (p["inside"] | (says == VARYING))
        return shown & ~F.coalesce(F.array_contains(F.get(constant, p["slot"]), F.xxhash64(p["line"])), F.lit(False))

    return F.array_join(F.transform(F.filter(parts, content), lambda p: p["line"]), "\n")


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def shapes(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html -> page_id, url, host, skel, tree, sig, bands, parts."""
    part = pa.struct([("slot", pa.int32()), ("inside", pa.bool_()), ("line", pa.string())])
    types = {"skel": pa.int64(), "tree": pa.string(), "sig": pa.int64(), "bands": pa.list_(pa.int64()), "parts": pa.list_(part)}

    def run(batches):
        for batch in batches:
            out = {name: [] for name in types}
            for page in batch.column(3):
                root = parse(page.as_py() or "")
                shape = json.dumps(skeleton(root), separators=(",", ":"))
                sig, bands = signature(root)
                parts = [{"slot": s, "inside": i, "line": t} for s, i, t in parts_of(root)]
                for name, value in zip(types, (xxhash.xxh64_intdigest(shape) >> 1, shape, sig, bands, parts)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(out[name], kind) for name, kind in types.items())], ["page_id", "url", "host", *types])

    kinds = "skel long, tree string, sig long, bands array<long>, parts array<struct<slot:int,inside:boolean,line:string>>"
    return pages.select("page_id", "url", "host", "html").mapInArrow(run, f"page_id long, url string, host string, {kinds}")


def contents(seen: DataFrame) -> DataFrame:
    """host, sig, bands -> c_id, content: the number of each page's content, one for all near copies on a host."""
    of = seen.select("host", F.xxhash64("host", "sig").alias("c_id"), F.explode("bands").alias("band")).distinct()
    least = of.groupBy("host", "band").agg(F.min("c_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    edges = of.join(least, ["host", "band"]).select("a", F.col("c_id").alias("b"))
    return components(edges).select(F.col("id").alias("c_id"), F.col("root").alias("content"))


def induce(seen: DataFrame) -> DataFrame:
    """shapes() -> host, skel, verdict, constant: for each skeleton of each host, its nodes' verdicts and template lines."""
    kinds = seen.groupBy("host", "skel").agg(F.first("tree").alias("tree"), F.count("*").alias("n"))
    models = kinds.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), "skel", "tree")).alias("m")).select(F.col("host").alias("m_host"), F.col("m.tree").alias("model"))

    def aligned(batches):
        for batch in batches:
            slots = []
            for skel, tree, model in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tree = json.loads(tree)
                at = align(tree, json.loads(model))
                # a node the model lacks is a slot of its own skeleton
                slots.append([str(at[i]) if i in at else f"{skel}:{i}" for i in range(numbered(tree)[1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.string()))], ["a_host", "a_skel", "slots"])

    paired = kinds.join(models, F.col("host") == F.col("m_host")).select("host", "skel", "tree", "model")
    slots = materialize(paired.mapInArrow(aligned, "a_host string, a_skel long, slots array<string>"), "wrapper-slots")
    on = (F.col("host") == F.col("a_host")) & (F.col("skel") == F.col("a_skel"))
    parts = seen.select("host", "skel", F.xxhash64("host", "sig").alias("id"), F.transform("parts", lambda p: F.struct(p["slot"].alias("at"), F.xxhash64(p["line"]).alias("h"))).alias("parts"))
    # a row for each node with lines: hashes of its lines
    nodes = parts.withColumn("at", F.explode(F.array_distinct("parts.at"))).select("host", "skel", "id", "at", F.transform(F.filter("parts", lambda p: p["at"] == F.col("at")), lambda p: p["h"]).alias("lines"))
    copies = contents(seen)
    cells = nodes.join(copies, F.col("id") == F.col("c_id"), "left").withColumn("content", F.coalesce("content", "id")).join(slots, on)
    cells = cells.select("host", "content", F.get("slots", F.col("at")).alias("slot"), "lines")
    cells = materialize(cells.distinct(), "wrapper-cells")
    by_text = cells.groupBy("host", "slot", F.xxhash64("lines").alias("text")).agg(F.countDistinct("content").alias("n"))
    by_text = by_text.groupBy("host", "slot").agg(F.max("n").alias("top"), F.count("*").alias("kinds"))
    by_slot = cells.groupBy("host", "slot").agg(F.countDistinct("content").alias("all")).filter(F.col("all") >= LEAST)
    by_line = cells.select("host", "slot", "content", F.explode("lines").alias("line")).distinct().groupBy("host", "slot", "line").agg(F.count("*").alias("n"))
    by_line = by_line.join(by_slot, ["host", "slot"]).filter((F.col("n") >= LEAST) & (F.col("n") >= CONSTANT * F.col("all"))).groupBy("host", "slot").agg(F.collect_set("line").alias("repeated"))
    fixed = (F.col("top") >= LEAST) & ((F.col("top") >= CONSTANT * F.col("all")) | (F.col("kinds") <= FEW * F.col("all")))
    judged = by_slot.join(by_text, ["host", "slot"]).join(by_line, ["host", "slot"], "left")
    judged = judged.select(F.col("host").alias("j_host"), F.col("slot").alias("j_slot"), F.when(fixed, TEMPLATE).otherwise(VARYING).alias("v"), F.coalesce("repeated", F.array().cast("array<long>")).alias("r"))
    nodes = slots.select("a_host", "a_skel", F.posexplode("slots").alias("at", "slot"))
    nodes = nodes.join(judged, (F.col("a_host") == F.col("j_host")) & (F.col("slot") == F.col("j_slot")), "left")
    node = F.struct("at", F.coalesce("v", F.lit(UNKNOWN)).alias("v"), F.coalesce("r", F.array().cast("array<long>")).alias("r"))
    out = nodes.groupBy("a_host", "a_skel").agg(F.sort_array(F.collect_list(node)).alias("all"))
    out = materialize(out.select(F.col("a_host").alias("host"), F.col("a_skel").alias("skel"), F.col("all.v").alias("verdict"), F.col("all.r").alias("constant")), "wrapper")
    release(slots, cells)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html -> page_id, url, text."""
    seen = materialize(shapes(pages), "wrapper-shapes")
    wrappers = induce(seen).select(F.col("host").alias("w_host"), F.col("skel").alias("w_skel"), "verdict", "constant")
    rows = seen.join(wrappers, (F.col("host") == F.col("w_host")) & (F.col("skel") == F.col("w_skel")), "left")
    return rows.select("page_id", "url", chosen(F.col("parts"), F.col("verdict"), F.col("constant")).alias("text"))


def op6_htmltext(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="long", url="string", html="string")
    out = extract_pages(pages.withColumn("host", host_of(F.col("url"))))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
