"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialweave.llm import dom
from trialweave.session import cut_lineage

#: A node is template where at least this share of the distinct pages that align with its reference page, and this many, have its text.
SHARE, PAGES = 0.9, 5
#: The reference pages of a host by the rank of their length, and the share of a reference's elements that a page which aligns with it has.
RANKS, ALIGNED = (0.0, 0.5, 0.75), 0.5
#: Wrappers are broadcast up to this many bytes of reference pages; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


class Wrapper:
    """A reference page of a host as a tree with numbered nodes, and the nodes known to be template."""

    def __init__(self, page: str, template: list[int] | None) -> None:
        self.tree = dom.pruned(dom.parse(page))
        self.number = {id(n): i for i, n in enumerate(dom.elements(self.tree))}
        self.texts = {self.number[id(n)]: t for n, t in _owned(self.tree).values()}
        self.template = frozenset(template or ())

    def same(self, tree: dom.Node, owned: dict[int, tuple[dom.Node, str]], least: float = 0) -> list[tuple[int, int]] | None:
        """(reference node, id of the page's node) of aligned nodes that hold the same text; None where less than that share of the reference aligns."""
        _, pairs = dom.align(self.tree, tree)
        if len(pairs) < least * len(self.number):
            return None
        out = []
        for reference, node in pairs:
            number = self.number[id(reference)]
            if number in self.texts and id(node) in owned and owned[id(node)][1] == self.texts[number]:
                out.append((number, id(node)))
        return out


def _owned(tree: dom.Node) -> dict[int, tuple[dom.Node, str]]:
    """By node: all text whose nearest block element is that node."""
    out: dict[int, tuple[dom.Node, str]] = {}
    for owner, text in dom.blocks(tree):
        out[id(owner)] = (owner, f"{out[id(owner)][1]}\n{text}" if id(owner) in out else text)
    return out


class _Wrappers:
    """Parsed wrappers of a task; hosts come mixed, so a bounded number is kept."""

    def __init__(self) -> None:
        self.kept: dict[tuple, Wrapper] = {}

    def get(self, page: str, template: list[int] | None) -> Wrapper:
        key = (page, tuple(template or ()))
        if key not in self.kept:
            if len(self.kept) >= 1000:
                self.kept.clear()
            self.kept[key] = Wrapper(page, template)
        return self.kept[key]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _observe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, reference, node, page digest): node -1 for each page that aligns with the reference, and each reference node whose text it repeats."""
    wrappers = _Wrappers()
    for part in parts:
        hosts, ranks, nodes, prints = [], [], [], []
        for host, page, references in zip(*(c.to_pylist() for c in part.columns)):
            tree = dom.pruned(dom.parse(page))
            owned = _owned(tree)
            digest = _digest("\n".join(t for _, t in owned.values()))
            for rank, reference in enumerate(references):
                same = wrappers.get(reference, None).same(tree, owned, ALIGNED)
                found = [] if same is None else [-1, *(n for n, _ in same)]
                hosts += [host] * len(found)
                ranks += [rank] * len(found)
                nodes += found
                prints += [digest] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ranks, pa.int32()), pa.array(nodes, pa.int32()), pa.array(prints, pa.int64())], names=["host", "rank", "node", "print"])


def extract_text(page: str | None, wrappers: Iterable[Wrapper] = ()) -> str:
    """Blocks of the main part, joined by line breaks, without furniture and template nodes."""
    if not page:
        return ""
    tree = dom.pruned(dom.parse(page))
    owned = _owned(tree)
    constant = {node for w in wrappers if w.template for number, node in w.same(tree, owned) if number in w.template}
    return "\n".join(t for part in dom.main_parts(tree) for owner, t in dom.blocks(part) if id(owner) not in constant)


def induce(pages: DataFrame) -> DataFrame:
    """(host, references, templates): up to three wrappers for each host with at least `PAGES` distinct page texts that align with one.

    `pages` has host and html. The references are the host's pages whose lengths have the ranks `RANKS` (ties by md5, so repeatable), so that a few
    stub pages leave a reference with text; every page of the host is aligned with each by simple tree matching. A reference node is template
    where `SHARE` of the distinct texts of the pages that align with the reference repeat its text at the aligned node; copies of a page
    count once, so they do not turn an article into template.
    """
    usable = pages.where("host IS NOT NULL AND host <> '' AND html <> ''").withColumn("n", F.length("html"))
    ranked = cut_lineage(usable.groupBy("host").agg(F.count("*").alias("all"), F.percentile_approx("n", list(RANKS)).alias("ranked")).where(F.col("all") >= PAGES).drop("all"))
    chosen = usable.join(ranked, "host").where("array_contains(ranked, n)").groupBy("host", "n").agg(F.min(F.struct(F.md5("html").alias("d"), "html")).alias("least"))
    references = cut_lineage(chosen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "least.html"))).alias("by")).select("host", F.col("by.html").alias("references")))
    seen = usable.join(sized(references), "host").select("host", "html", "references")
    observed = seen.mapInArrow(_observe, "host string, rank int, node int, print long").distinct()
    counts = observed.groupBy("host", "rank", "node").agg(F.count("*").alias("n"))
    of_reference = counts.where(f"node = -1 AND n >= {PAGES}").select("host", "rank", F.col("n").alias("all"))
    template = (
        counts.where("node >= 0").join(of_reference, ["host", "rank"]).where(F.col("n") >= SHARE * F.col("all"))
        .groupBy("host", "rank").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        .groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("rank", "nodes"))).alias("nodes"))
    )
    return cut_lineage(references.join(template, "host").select("host", "references", F.transform("references", lambda _, i: F.col("nodes")[i]).alias("templates")))


def sized(table: DataFrame) -> DataFrame:
    """Broadcast the wrappers where their measured size allows; otherwise the join shuffles, and AQE splits a hot host."""
    size = table.agg(F.coalesce(F.sum(F.length(F.concat_ws("", "references")) + 64), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for each page; one row for each row.

    Null or empty html gives an empty text and 0. A page whose url is null or has no host, or whose host has too few distinct pages,
    is read without a wrapper. Repeated rows and null keys keep their rows; other columns are not read, whatever their names.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"))
    wrappers = induce(rows.select("host", "html"))

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for part in parts:
            texts = [
                extract_text(h, [known.get(*w) for w in zip(r or (), t or ()) if w[1]])
                for h, r, t in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.join(sized(wrappers), "host", "left")
        .select("key", "url", "html", "references", "templates")
        .mapInArrow(extract, f"key {kind}, url string, text string, n_chars long")
        .withColumnRenamed("key", key)
    )
