"""Drawing a graph: attributes of nodes and edges as frames, and a self-contained HTML page of a bounded part."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import looked_up, palette
from graphloom.graph import PropertyGraph

# fixed values: colours of types, of strengths, and the palette that types without one go through
TYPE_COLORS = {"Person": "#87CEFA", "Organization": "#90EE90", "Location": "#FFA07A"}
STRENGTH_COLORS = {"strong": "#000000", "medium": "#808080", "weak": "#C0C0C0"}
OTHER_NODE, OTHER_EDGE = "#D3D3D3", "#808080"
PALETTE = ["#4e79a7", "#f28e2c", "#e15759", "#76b7b2", "#59a14f", "#edc949", "#af7aa1", "#ff9da7", "#9c755f", "#bab0ab"]


def node_titles(graph: PropertyGraph) -> DataFrame:
    """id, title: what a node's tooltip says, its type and all its properties, one a line."""
    return graph.nodes.select("id", _title(F.col("type"), F.col("props")).alias("title"))


def edge_titles(graph: PropertyGraph) -> DataFrame:
    """src, dst, label (the type), title of each edge, as node_titles()."""
    return graph.edges.select("src", "dst", F.coalesce("type", F.lit("NA")).alias("label"), _title(F.col("type"), F.col("props")).alias("title"))


def _title(kind, props):
    lines = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.concat(F.array_compact(F.array(F.concat(F.lit("type: "), kind))), F.coalesce(lines, F.array().cast("array<string>"))), "\n")


def mapped_nodes(graph: PropertyGraph, by: str = "type", colors: dict[str, str] | None = None) -> DataFrame:
    """id, label, color by a property's value; grey for others."""
    value = F.col(by) if by in ("id", "name", "type") else F.col("props")[by]
    return graph.nodes.select("id", F.col("name").alias("label"), looked_up(value, TYPE_COLORS if colors is None else colors, OTHER_NODE).alias("color"))


def strength_edges(graph: PropertyGraph) -> DataFrame:
    """src, dst, label (the relation's types), color by strength."""
    return graph.edges.select("src", "dst", F.coalesce("type", F.lit("")).alias("label"), looked_up(F.col("props")["strength"], STRENGTH_COLORS, OTHER_EDGE).alias("color"))


def type_colors(graph: PropertyGraph) -> DataFrame:
    """type, color: the palette in the order of the types (null is NA), going round."""
    types = graph.nodes.select(F.coalesce("type", F.lit("NA")).alias("type")).distinct()
    return types.withColumn("__n", F.row_number().over(Window.orderBy("type")) - 1).select("type", palette(F.col("__n"), PALETTE).alias("color"))  # one row a type


def palette_nodes(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.select("id", F.coalesce("name", F.lit("NA")).alias("label"), F.coalesce("type", F.lit("NA")).alias("type")).join(type_colors(graph), "type").select("id", "label", "type", "color")


def palette_edges(graph: PropertyGraph) -> DataFrame:
    """src, dst, label, color: an edge has the colour of its target's type."""
    to = palette_nodes(graph).select(F.col("id").alias("dst"), "color")
    return graph.edges.select("src", "dst", F.coalesce("type", F.lit("NA")).alias("label")).join(to, "dst").select("src", "dst", "label", "color")


def page(nodes: DataFrame, edges: DataFrame, legend: DataFrame | None = None, most: int = 2000) -> str:
    """An HTML page that draws at most `most` nodes (by id) and as many edges between them (by src, dst, label), and says how many of how many it draws.

    Columns title of nodes and edges are their tooltips; without them ids and labels are.
    """
    ends = nodes.orderBy("id").limit(most)
    shown = ends.toPandas()
    held = set(shown["id"])
    ids = ends.select("id")
    order = [c for c in ("src", "dst", "label") if c in edges.columns]
    between = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    lines = between.orderBy(*order).limit(most).toPandas()
    lines = lines[lines["src"].isin(held) & lines["dst"].isin(held)]
    colors = [] if legend is None else [(r.type, r.color) for r in legend.orderBy("type").limit(most).collect()]
    data = json.dumps({"nodes": shown.to_dict("records"), "edges": lines.to_dict("records")}).replace("</", "<\\/")
    key = "".join(f"<div><span style='color:{html.escape(c)}'>&#9679;</span> {html.escape(str(t))}</div>" for t, c in colors)
    said = f"<div>{len(shown)} of {nodes.count()} nodes, {len(lines)} of {edges.count()} edges</div>"
    return _PAGE.replace("@DATA@", data).replace("@KEY@", said + key)


def write_page(graph: PropertyGraph, path: str, most: int = 2000) -> str:
    """Writes the page on the driver, for a person to open; gives its path."""
    nodes = palette_nodes(graph).join(node_titles(graph), "id")
    edges = palette_edges(graph).join(edge_titles(graph).groupBy("src", "dst", "label").agg(F.min("title").alias("title")), ["src", "dst", "label"], "left")
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(nodes, edges, type_colors(graph), most))
    return path


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body style="font-family:sans-serif">
<svg id="g" width="1000" height="750"></svg><div id="key">@KEY@</div><script>
const d = @DATA@, at = {}, svg = document.getElementById("g"), ns = "http://www.w3.org/2000/svg";
d.nodes.forEach((n, i) => { const a = 2 * Math.PI * i / d.nodes.length; at[n.id] = [500 + 440 * Math.cos(a), 375 + 330 * Math.sin(a)]; });
const add = (k, p, t) => { const e = document.createElementNS(ns, k); for (const x in p) e.setAttribute(x, p[x]); if (t) { const s = document.createElementNS(ns, "title"); s.textContent = t; e.appendChild(s); } svg.appendChild(e); return e; };
d.edges.forEach(e => { const [a, b] = at[e.src], [x, y] = at[e.dst]; add("line", {x1: a, y1: b, x2: x, y2: y, stroke: e.color}, e.title || e.label); });
d.nodes.forEach(n => { const [x, y] = at[n.id]; add("circle", {cx: x, cy: y, r: 5, fill: n.color}, n.id + (n.title ? "\\n" + n.title : "")); add("text", {x: x + 7, y: y, "font-size": 9}).textContent = n.label; });
</script></body></html>
"""
