"""Documentation: pages to text and chunks, nearest chunks, and the quality of retrieval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import content
from faultline.sources.storage import stored

# Fixed values
DROPPED = ("script", "style", "nav", "footer", "header")
MAIN = ("main", "article", ".content", "#content", ".documentation", ".doc-content", "body")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Reader(HTMLParser):
    """Text of a page by the main elements it has, without dropped blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[int]]] = []
        self.open: Counter[str] = Counter()  # of the stack's tags
        self.hidden = 0  # of them dropped ones
        self.found: dict[int, list[str]] = {}
        self.done: set[int] = set()
        self.title: list[str] | None = None
        self.titles: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = {tag, *(f".{x}" for x in (a.get("class") or "").split()), f"#{a.get('id')}"}
        dropped = self.hidden or tag in DROPPED  # such blocks are gone before a main element is looked for
        own = [] if dropped else [i for i, m in enumerate(MAIN) if m in names and i not in self.found]
        for i in own:
            self.found[i] = []
        if tag in _VOID:
            self.done.update(own)
        else:
            self.stack.append((tag, own))
            self.open[tag] += 1
            self.hidden += tag in DROPPED

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self.stack:
                t, own = self.stack.pop()
                self.open[t] -= 1
                self.hidden -= t in DROPPED
                self.done.update(own)
                if t == tag:
                    break

    def handle_data(self, data):
        if self.open["title"]:
            self.titles.append(data)
        text = data.strip()
        if text and not self.hidden:
            for i in self.found:
                if i not in self.done:
                    self.found[i].append(text)


def _read(html: str) -> tuple[str, str]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    first = min(reader.found, default=None)
    return "".join(reader.titles).strip(), "" if first is None else "\n".join(reader.found[first])


def page_text(pages: DataFrame) -> DataFrame:
    """source, url, title, content of pages (source, url, html); pages without content are dropped.  The title falls back on the url."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            read = [_read(h) for h in b.column(2).to_pylist()]
            title = [t or u for (t, _), u in zip(read, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(title, pa.string()), pa.array([c for _, c in read], pa.string())], ["source", "url", "title", "content"])

    kind = pages.schema["source"].dataType.simpleString()
    return pages.select("source", "url", "html").mapInArrow(run, f"source {kind}, url string, title string, content string").filter("content <> ''")


def page_links(html: Column, url: Column, base: Column) -> Column:
    """Distinct absolute links under ``base`` in order, without those in dropped blocks."""
    bare = F.regexp_replace(content(html), r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}(?=[\s>/]).*?</{tag}\s*>", "")
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    hrefs = F.regexp_extract_all(bare, F.lit(rf"(?is)<a(?=\s)[^>]*?\shref\s*=\s*{value}"), 1)
    hrefs = F.transform(hrefs, lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    for written, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        hrefs = F.transform(hrefs, lambda h: F.replace(h, F.lit(written), F.lit(meant)))  # noqa: B023
    base, here = F.regexp_replace(base, "/+$", ""), F.regexp_replace(url, r"/[^/]*$", "")
    full = F.transform(hrefs, lambda h: F.when(h.startswith("/"), F.concat(base, h)).when(~h.startswith("http"), F.concat(here, F.lit("/"), h)).otherwise(h))
    return F.array_distinct(F.filter(full, lambda x: F.contains(x, base)))


def sections(docs: DataFrame) -> DataFrame:
    """source, url, section_no, title, content: a break before each line of up to 101 characters that starts A-Z and has a line after it."""
    parts = F.split("content", "\\n(?=[A-Z][^\\n]{0,100}\\n)", -1)
    out = docs.select("source", "url", F.posexplode(parts).alias("section_no", "part"))
    title, rest = F.substring_index("part", "\n", 1), F.expr("substring(part, instr(part, '\n') + 1)")
    return out.select("source", "url", "section_no", title.alias("title"), F.when(F.contains("part", F.lit("\n")), rest).otherwise(title).alias("content"))


def chunks(docs: DataFrame, size: int = 500, separator: str = "\n\n") -> DataFrame:
    """source, url, chunk_no (from 0 within a document), title, content: sections, long ones packed greedily from paragraphs."""
    paragraphs = F.split("content", separator, -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(acc, p):
        flush = acc["open"].isNotNull() & (acc["size"] + F.length(p) > size)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush | acc["open"].isNull(), p).otherwise(F.concat(acc["open"], F.lit(separator), p)).alias("open"),
            (F.when(flush, 0).otherwise(acc["size"]) + F.length(p)).alias("size"),
        )

    packed = F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    own = sections(docs).withColumn("parts", F.when(F.length("content") > size, packed).otherwise(F.array("content")))
    by_doc = Window.partitionBy("source", "url").orderBy("section_no", "at")
    flat = own.select("source", "url", "section_no", "title", F.posexplode("parts").alias("at", "content"))
    return flat.select("source", "url", (F.row_number().over(by_doc) - 1).alias("chunk_no"), "title", "content")


#: Cells of the search at most; their centres are vectors that the driver and each task hold.
MOST_CELLS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _centres(chunks: DataFrame, n: int, most: int) -> np.ndarray:
    """Vectors of the ``n`` chunks that stand for cells: half the root of their number, those with the least hashes."""
    rows = chunks.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(max(1, min(most, math.isqrt(n) // 2))).select("embedding").collect()
    return np.array([r.embedding for r in rows], float)


def _in_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``chunks`` with cell, that of the nearest centre, and away, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            d = _distances(_matrix(b.column(2)), centres) if len(b) else np.zeros((0, len(centres)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d[np.arange(len(d)), cell]))], [*b.schema.names, "cell", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{kinds}, cell int, away double")


def _visits(asked: DataFrame, centres: np.ndarray, k: int, again: bool) -> DataFrame:
    """A row for each cell that a query has to visit: its nearest cells till they have ``k`` chunks, or ``again`` all others that can have nearer ones.

    asked: query_id, source, embedding, cells (cell, n, radius) and, for ``again``, reach: the squared distance of the k-th found so far (null: fewer were found).
    By the triangle inequality a cell has nothing nearer than the distance to its centre less its radius.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            at, cells = [], []
            d = np.sqrt(_distances(_matrix(b.column(2)), centres)) if len(b) else None
            for i, own in enumerate(b.column(3).to_pylist()):
                cell, n, radius = (np.array([x[f] for x in own]) for f in ("cell", "n", "radius"))
                order = np.lexsort((cell, d[i, cell]))
                first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                if again:
                    reach = b.column(4)[i].as_py()
                    low = np.maximum(d[i, cell] - radius, 0)
                    can = np.ones(len(cell), bool) if reach is None else low <= np.sqrt(reach) * (1 + 1e-9) + 1e-6
                    can[first] = False
                    first = np.nonzero(can)[0]
                at += [i] * len(first)
                cells += cell[first].tolist()
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int32())) for c in b.columns[:3]), pa.array(cells, pa.int32())], ["query_id", "source", "embedding", "cell"])

    kinds = [f"{n} {asked.schema[n].dataType.simpleString()}" for n in ("query_id", "source", "embedding")]
    return asked.mapInArrow(run, ", ".join([*kinds, "cell int"]))


def _met(visits: DataFrame, held: DataFrame, k: int, filtered: bool, query_block: int, chunk_block: int) -> DataFrame:
    """query_id, chunk_id, source, distance: the ``k`` nearest of each block of a cell for each query that visits it.

    A cell's chunks are dealt to blocks and its visits to others; chunks are copied once for each block of visits, visits once for each block of chunks.
    """
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk_block).cast("int").alias("down"))
    calls = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("across"))
    grid = F.broadcast(sizes.join(calls, "cell"))  # MOST_CELLS rows at most
    own = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = visits.join(grid, "cell").select("query_id", "source", "embedding", "cell", own("query_id", "across").alias("q"), each("down").alias("c"))
    right = held.join(grid, "cell").select("chunk_id", "source", "embedding", "cell", own("chunk_id", "down").alias("c"), each("across").alias("q"))

    def best(q: pa.Table, x: pa.Table) -> pa.Table:
        parts = [[], [], []]
        if len(q) and len(x):
            x = x.sort_by("chunk_id")
            b = _matrix(x.column("embedding").combine_chunks())
            theirs = x.column("source").to_pandas().to_numpy()
            for start in range(0, len(q), 512):
                some = q.slice(start, 512)
                d = _distances(_matrix(some.column("embedding").combine_chunks()), b).round(9)
                if filtered:
                    d[some.column("source").to_pandas().to_numpy()[:, None] != theirs[None, :]] = np.inf
                most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, col = np.nonzero((d <= most[:, None]) & np.isfinite(d))
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                for out, v in zip(parts, (row[kept] + start, col[kept], d[row[kept], col[kept]]), strict=True):
                    out.append(v)
        row, col = (np.concatenate([np.zeros(0, int), *p]) for p in parts[:2])
        take = lambda t, name, i: t.column(name).take(pa.array(i))
        return pa.table([take(q, "query_id", row), take(x, "chunk_id", col), take(x, "source", col), pa.array(np.concatenate([np.zeros(0), *parts[2]]))], ["query_id", "chunk_id", "source", "distance"])

    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((visits, "query_id"), (held, "chunk_id"), (held, "source"))]
    by = ["cell", "c", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, ", ".join([*kinds, "distance double"]))


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 5, query_block: int = 1 << 16, chunk_block: int = 8192, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, chunk_id, source, distance (squared L2, 9 places), rank of the k nearest chunks of each query; ties by chunk_id.

    queries: query_id (each once), embedding and, if wanted, source_filter.  The search is exact: chunks are dealt to cells about some of them; a query
    visits the nearest cells first, and then only cells that can have something nearer than what it has found, by the triangle
    inequality.  Rows without a vector have no distance and are left out; a filter that no chunk has finds nothing.
    """
    filtered = "source_filter" in queries.columns
    chunks = chunks.select("chunk_id", "source", "embedding").filter("embedding is not null")
    n = chunks.count()
    source = chunks.schema["source"].dataType
    asked = queries.filter("embedding is not null").select("query_id", (F.col("source_filter") if filtered else F.lit(None)).cast(source).alias("source"), "embedding")
    merged = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
    if n <= chunk_block:  # one cell of one block: there is nothing to leave out
        return ranked(_met(asked.withColumn("cell", F.lit(0)), chunks.withColumn("cell", F.lit(0)), k, filtered, query_block, chunk_block))
    centres = _centres(chunks, n, most_cells)
    held = stored(_in_cells(chunks, centres), "chunks-in-cells")
    facts = held.groupBy("source", "cell") if filtered else held.groupBy(F.lit(None).cast(source).alias("source"), "cell")
    cells = F.collect_list(F.struct("cell", "n", "radius"))  # MOST_CELLS at most
    lists = facts.agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).groupBy("source").agg(cells.alias("cells"))
    lists = stored(lists.withColumnRenamed("source", "_source"), "cells")
    same = F.col("source") == F.col("_source") if filtered else F.lit(True)
    known = stored(asked.join(F.broadcast(lists) if lists.count() <= 4096 else lists, same).drop("_source"), "asked")
    first = stored(ranked(_met(_visits(known, centres, k, False), held, k, filtered, query_block, chunk_block)).drop("rank"), "found")
    reach = first.groupBy(F.col("query_id").alias("_query")).agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
    further = known.join(reach, F.col("query_id") == F.col("_query"), "left").select("query_id", "source", "embedding", "cells", F.when(F.col("n") >= k, F.col("d")).alias("reach"))
    visits = stored(_visits(further, centres, k, True), "visits")
    return ranked(first.unionByName(_met(visits, held, k, filtered, query_block, chunk_block)))


def routed(mentions: DataFrame, by_tool: DataFrame, general: DataFrame, keep: int = 5, each: int = 3) -> DataFrame:
    """log_id, chunk_id, rank: the first of each mentioned tool in their fixed order, else the general query's.

    mentions: log_id, tools; by_tool: tool, chunk_id, rank; general: log_id, chunk_id, rank.
    """
    by = mentions.select("log_id", F.posexplode("tools").alias("at", "tool")).join(by_tool.filter(F.col("rank") <= each), "tool")
    best = Window.partitionBy("log_id").orderBy("at", "rank")
    found = by.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).select("log_id", "chunk_id", F.col("r").alias("rank"))
    rest = general.join(found.select("log_id").distinct(), "log_id", "left_anti").filter(F.col("rank") <= keep)
    return found.unionByName(rest.select("log_id", "chunk_id", "rank"))


def docs_block(found: DataFrame) -> DataFrame:
    """log_id, block: the retrieved documents (log_id, rank, source, section, content, url) as text for a prompt."""
    one = F.concat(F.lit("[Documentation from "), "source", F.lit(" - "), "section", F.lit("]\n"), "content", F.lit("\nSource: "), "url")
    rows = found.select("log_id", F.struct("rank", one.alias("text")).alias("x")).groupBy("log_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("log_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n\n").alias("block"))


def retrieval_quality(found: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """precision_at_5, recall_at_5, mrr over queries: found (query_id, chunk_id, rank to 10), relevant (query_id, chunk_id)."""
    hit = found.join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("h"), F.min("rank").alias("first"))
    size = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    per = queries.select("query_id").join(hit, "query_id", "left").join(size, "query_id", "left")
    h = F.coalesce("h", F.lit(0))
    return per.agg(F.avg(h / 5).alias("precision_at_5"), F.avg(F.coalesce(F.try_divide(h, F.col("size")), F.lit(0.0))).alias("recall_at_5"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def with_without(results: DataFrame) -> DataFrame:
    """arm, mean_fix_quality (missing: 0), cited: share with a documentation reference."""
    return results.groupBy("arm").agg(F.avg(F.coalesce("fix_quality", F.lit(0.0))).alias("mean_fix_quality"), F.avg((F.coalesce(F.size("documentation_references"), F.lit(0)) > 0).cast("double")).alias("cited"))


def index_stats(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def write_index(chunked: DataFrame, path: str, update: bool = False) -> None:
    """Write chunks by source; an update replaces the sources that it has."""
    mode = "dynamic" if update else "static"
    chunked.repartition("source", F.pmod("chunk_no", F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("source").parquet(path)
