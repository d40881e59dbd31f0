"""Parsed pages: each page's nodes as an array in document order, where a subtree is a range. A page is parsed once; what is dropped, selected, counted or written of it is work on that column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import dom
from lakeweave.functions.slices import by_slices, in_slices

NODE = pa.struct([("tag", pa.string()), ("end", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
#: A node of null tag is a text or, without one, a comment; ``end`` is the place behind its subtree, counted from 0.
NODES = "array<struct<tag:string,end:int,attrs:map<string,string>,text:string>>"
Flat = tuple[list, list, list, list]


def flat(root: dom.Node) -> tuple[Flat, list[dom.Node]]:
    """Tags, ends, attributes and texts of all nodes in document order, and the nodes."""
    nodes: list[dom.Node] = []
    ends: list[int] = []
    stack: list[dom.Node | int] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, int):
            ends[n] = len(nodes)
            continue
        nodes.append(n)
        ends.append(len(nodes))
        if n.kids:
            stack.append(len(nodes) - 1)
            stack.extend(reversed(n.kids))
    return ([n.tag for n in nodes], ends, [list(n.attrs.items()) for n in nodes], [n.text for n in nodes]), nodes


def tree(tags: list, ends: list, attrs: list, texts: list) -> list[dom.Node]:
    """The nodes in document order, joined to a tree; the first is its root."""
    nodes = [dom.Node(t, dict(a) if a else None, x or "") for t, a, x in zip(tags, attrs, texts, strict=True)]
    above: list[int] = []
    for i, n in enumerate(nodes):
        while above and ends[above[-1]] <= i:
            above.pop()
        if above:
            nodes[above[-1]].add(n)
        if ends[i] > i + 1:
            above.append(i)
    return nodes


def page_nodes(nodes: pa.Array) -> Iterator[Flat | None]:
    """The four lists of each page of a column of ``NODES``."""
    values = nodes.values
    fields = [values.field(i) for i in range(4)]
    offsets = nodes.offsets.to_numpy()
    for i in range(len(nodes)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield tuple(f.slice(a, b - a).to_pylist() for f in fields) if nodes[i].is_valid else None


def node_array(pages: list[Flat | None]) -> pa.Array:
    """A column of ``NODES``."""
    offsets = np.cumsum([0, *(len(p[0]) if p else 0 for p in pages)])
    joined = [[x for p in pages if p for x in p[k]] for k in range(4)]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(joined, NODE, strict=True)], fields=list(NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([p is None for p in pages], pa.bool_()))


def parsed(pages: DataFrame, found: Callable[[dom.Node], list[tuple[dom.Node, str, str | None]]] | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with their html replaced by ``nodes``; null html has none.

    With ``found``, a function that lists (node, kind, uri) of a tree and may change it, the rows
    get ``found`` too: structs of ordinal, node (its place), tag, kind, raw_uri, has_child_tags.
    """
    listed = pa.list_(pa.struct([("ordinal", pa.int32()), ("node", pa.int32()), ("tag", pa.string()), ("kind", pa.string()), ("raw_uri", pa.string()), ("has_child_tags", pa.bool_())]))
    others = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in in_slices(*batch.columns)):
            flats, lists = [], []
            for html in part[-1]:
                if not html.is_valid:
                    flats.append(None)
                    lists.append([])
                    continue
                root = dom.parse(html.as_py())
                seen = found(root) if found else []
                lists_of, nodes = flat(root)
                place = {id(n): i for i, n in enumerate(nodes)}
                flats.append(lists_of)
                lists.append([{"ordinal": k, "node": place.get(id(n), -1), "tag": n.tag, "kind": kind, "raw_uri": uri, "has_child_tags": any(c.tag for c in n.kids)} for k, (n, kind, uri) in enumerate(seen)])
            columns = [*part[:-1], node_array(flats), *([pa.array(lists, listed)] if found else [])]
            yield pa.RecordBatch.from_arrays(columns, [*others, "nodes", *(["found"] if found else [])])

    schema = T.StructType([pages.schema[c] for c in others]).add("nodes", T._parse_datatype_string(NODES))
    if found:
        schema = schema.add("found", T._parse_datatype_string("array<struct<ordinal:int,node:int,tag:string,kind:string,raw_uri:string,has_child_tags:boolean>>"))
    return pages.select(*others, html_col).mapInArrow(run, schema)


def of_tag(*tags: str) -> Callable[[Column], Column]:
    return lambda n: F.coalesce(n["tag"].isin(*tags), F.lit(False))


def count_nodes(nodes: Column, test: Callable[[Column], Column]) -> Column:
    """How many nodes pass a test on structs."""
    return F.size(F.filter(nodes, test))


def has_class(name: str) -> Callable[[Column], Column]:
    return lambda n: F.coalesce(F.array_contains(F.split(F.try_element_at(n["attrs"], F.lit("class")), r"\s+"), name), F.lit(False))


def subtree(nodes: Column, test: Callable[[Column], Column]) -> Column:
    """The subtree of the first node that passes the test, its ends counted from its own start; null without one."""
    at = F.try_element_at(F.filter(F.transform(nodes, lambda n, i: F.struct(i.alias("i"), n["end"].alias("end"), test(n).alias("hit"))), lambda x: x["hit"]), F.lit(1))
    part = F.slice(nodes, at["i"] + 1, at["end"] - at["i"])
    return F.when(at.isNotNull(), F.transform(part, lambda n: F.struct(n["tag"].alias("tag"), (n["end"] - at["i"]).alias("end"), n["attrs"].alias("attrs"), n["text"].alias("text"))))


def without(nodes: Column, *tags: str) -> Column:
    """The nodes without the subtrees of the tags: ranges are cut out, ends move up by what went before them."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for page in page_nodes(column):
            if page is None:
                out.append(None)
                continue
            gone = np.zeros(len(page[0]) + 1, np.int32)
            for i, tag in enumerate(page[0]):
                if tag in tags:
                    gone[i] += 1
                    gone[page[1][i]] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            before = np.concatenate([[0], np.cumsum(stay)])
            keep = np.flatnonzero(stay).tolist()
            out.append(([page[0][i] for i in keep], [int(before[page[1][i]]) for i in keep], [page[2][i] for i in keep], [page[3][i] for i in keep]))
        return node_array(out)

    return by_slices(run, NODES)(nodes)


def _written(write: Callable[[dom.Node], str]) -> Callable[[Column], Column]:
    def run(nodes: pa.Array) -> pa.Array:
        return pa.array([None if p is None else write(tree(*p)[0]) if p[0] else "" for p in page_nodes(nodes)], pa.string())

    return by_slices(run, T.StringType())


#: HTML of the nodes.
node_html = _written(dom.serialize)
#: Markdown of the nodes, not yet tidy.
node_markdown = _written(dom.markdown)
#: Visible text of the nodes.
node_text = _written(dom.text_of)
