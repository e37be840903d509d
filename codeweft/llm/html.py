"""Main text of web pages from flat text blocks.

A page becomes a flat list of blocks: text between block-level tags, with its word count, its link
density, those of its neighbours, and whether it stands inside an article or inside something
marked as page furniture. A decision tree decides which blocks are main text. The tree is
trained by pyspark.ml on the small labelled table below; pages are then mapped batch by batch,
without a shuffle."""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import fresh

# Fixed element names.
SILENT = set("script style noscript template iframe object svg math head title textarea select button option canvas audio video".split())
FURNITURE = set("nav header footer aside form menu dialog fieldset".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe".split())
# Words in class, id or role that mark furniture.
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|nav\w*|menu|breadcrumbs?|"
                    r"side-?bar|footer|masthead|site-?header|page-?header|comments?|replies|disqus|share|sharing|social|related|"
                    r"recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|pagination|search|"
                    r"navigation|complementary|contentinfo|alert|dialog)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "in_article", "furniture")
# Labelled blocks: the features in order, then 1 for main text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0),
    (9, 0.0, 2, 1.0, 11, 0.0, 0, 1, 0), (11, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1), (60, 0.0, 11, 0.0, 2, 0.0, 1, 0, 1),
    (2, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1), (80, 0.0, 2, 0.0, 45, 0.02, 1, 0, 1), (45, 0.02, 80, 0.0, 14, 0.0, 1, 0, 1),
    (14, 0.0, 45, 0.02, 0, 0.0, 0, 1, 0), (3, 0.0, 40, 0.0, 6, 1.0, 1, 0, 1), (6, 1.0, 3, 0.0, 30, 0.1, 1, 0, 1),
    (30, 0.1, 6, 1.0, 5, 0.0, 1, 0, 1), (5, 0.0, 30, 0.1, 12, 0.8, 1, 0, 1), (12, 0.8, 5, 0.0, 4, 1.0, 0, 1, 0),
    (25, 0.0, 4, 1.0, 30, 0.0, 1, 1, 0), (30, 0.0, 25, 0.0, 2, 1.0, 1, 1, 0), (2, 1.0, 30, 0.0, 8, 0.0, 1, 1, 0),
    (8, 0.0, 2, 1.0, 0, 0.0, 0, 1, 0), (40, 0.0, 0, 0.0, 55, 0.0, 0, 0, 1), (55, 0.0, 40, 0.0, 70, 0.05, 0, 0, 1),
    (70, 0.05, 55, 0.0, 22, 0.0, 0, 0, 1), (22, 0.0, 70, 0.05, 3, 1.0, 0, 0, 1), (3, 1.0, 22, 0.0, 3, 1.0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 3, 1.0, 4, 0.5, 0, 0, 0), (4, 0.5, 2, 1.0, 0, 0.0, 0, 0, 0),
    (7, 0.0, 3, 1.0, 48, 0.0, 0, 0, 1), (48, 0.0, 7, 0.0, 1, 0.0, 0, 0, 1), (6, 0.9, 48, 0.0, 5, 0.9, 0, 0, 0),
    (5, 0.9, 6, 0.9, 4, 1.0, 0, 0, 0), (18, 0.7, 4, 1.0, 3, 1.0, 0, 0, 0), (35, 0.6, 5, 1.0, 5, 1.0, 0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 90, 0.0, 1, 0, 1), (90, 0.0, 1, 0.0, 0, 0.0, 1, 0, 1),
    (120, 0.0, 10, 0.0, 0, 0.0, 0, 1, 0), (20, 0.3, 0, 0.0, 15, 0.0, 0, 1, 0), (4, 0.0, 50, 0.0, 50, 0.0, 0, 0, 1),
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (3, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1), (4, 1.0, 90, 0.0, 0, 0.0, 1, 0, 1),
)


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks in page order: text, words, words in links, inside an article, furniture.

    Markup may be broken: an end tag closes back to its start tag if one is open, else nothing; a
    tag that the page ends in is dropped; script and style text ends at its own end tag only."""
    out, pieces, linked = [], [], 0
    open_: list[tuple[str, bool, bool, bool, bool]] = []     # name, article, furniture, silent, link

    def close_block():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            n = len(text.split())
            _, article, furniture, _, _ = open_[-1] if open_ else ("", False, False, False, False)
            out.append((text, n, min(linked, n), article, furniture))
        pieces.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        if not raw or (open_ and open_[-1][3]):
            return
        text = entities.unescape(raw)
        pieces.append(text)
        if open_ and open_[-1][4]:
            linked += len(text.split())

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, ending = m[2].lower(), bool(m[1])
        if not page.endswith(">", m.start(), m.end()):
            break                                        # the page ends inside a tag
        if name not in INLINE:
            close_block()
        elif name in ("img", "wbr") and not ending:
            continue
        if ending:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if depth is not None and (name not in INLINE or all(o[0] in INLINE for o in open_[depth:])):
                del open_[depth:]
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p" and open_:                        # a paragraph ends an open one
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] not in INLINE), None)
            if depth is not None and open_[depth][0] == "p":
                del open_[depth:]
        _, article, furniture, silent, link = open_[-1] if open_ else ("", False, False, False, False)
        marks = " ".join(x for a in _ATTR.findall(m[3]) for x in a if x)
        furniture = (furniture or bool(marks and name not in ("html", "body", "article", "main") and MARKED.search(marks))
                     or (name in FURNITURE and not (name == "header" and article)))
        open_.append((name, article or name in ("article", "main"), furniture, silent or name in SILENT,
                      link or name == "a"))
        if name in RAW:
            end = re.compile(f"</{name}[\\s>/]", re.I).search(page, at)
            at = end.start() if end else len(page)
    else:
        rest = page[at:]
        # a last "<" that begins a tag is markup
        add(re.sub(r"</?[A-Za-z!?][^>]*\Z", "", rest))
    close_block()
    return out


def features_of(blocks) -> list[tuple[float, ...]]:
    own = [(float(n), links / n) for _, n, links, _, _ in blocks]
    pad = [(0.0, 0.0), *own, (0.0, 0.0)]
    return [(*pad[i + 1], *pad[i], *pad[i + 2], float(b[3]), float(b[4])) for i, b in enumerate(blocks)]


def train_tree(spark: SparkSession, labelled=LABELLED, depth: int = 5):
    """The tree of a pyspark.ml decision tree trained on `labelled`, as nested tuples
    (feature, threshold, left, right) with labels as leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([float(x) for x in r[:-1]]), float(r[-1])) for r in labelled]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table)

    def plain(node):
        if node.numDescendants() == 0:
            return int(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), plain(node.leftChild()), plain(node.rightChild()))

    return plain(model._call_java("rootNode"))


def is_main(tree, features) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def extract(pages: DataFrame, html: str = "html", tree=None) -> DataFrame:
    """`pages` without `html`, plus `text` (main blocks in page order, one space apart; "" if there
    are none), `n_blocks` and `n_main`.

    Character references are decoded, white space inside a block becomes one space. Null and empty
    pages give "". Rows are mapped one by one: repeats stay, other columns pass through (columns
    called text, n_blocks or n_main are replaced); an empty table gives no rows."""
    tree = tree or train_tree(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_blocks", "n_main")]
    (page_html,) = fresh(pages.columns, "html")
    schema = pages.select(*keep).schema.add("text", "string").add("n_blocks", "integer").add("n_main", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_, main = [], [], []
            for page in batch.column(page_html):
                blocks = blocks_of(page.as_py() or "")
                good = [b[0] for b, f in zip(blocks, features_of(blocks)) if is_main(tree, f)]
                texts.append(" ".join(good))
                all_.append(len(blocks))
                main.append(len(good))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(all_, pa.int32()), pa.array(main, pa.int32())],
                names=[*keep, "text", "n_blocks", "n_main"])

    return pages.select(*keep, pages[html].alias(page_html)).mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")
