"""Writers: term lists, matrices and graphs (CSV, D3 JSON, node-link JSON, GraphML, GEXF, DOT, HTML).

A graph that goes into one file is checked against ``FILE_ITEMS`` first; larger ones are written as tables.
"""

from __future__ import annotations

import json
import os
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import graph as graphs
from textloom.operators import metrics

FILE_ITEMS = 1_000_000


class EmptyOutputError(ValueError):
    """There is nothing to write."""


def require_rows(df: DataFrame, what: str, least: int = 1) -> DataFrame:
    if df.limit(least).count() < least:
        raise EmptyOutputError(f"{what}: fewer than {least} rows")
    return df


def require_graph(g: graphs.ConceptGraph, edges: bool = True) -> graphs.ConceptGraph:
    require_rows(g.nodes, "graph nodes")
    if edges:
        require_rows(g.edges, "graph edges")
    return g


def _text(path: str, content: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    return path


def matrix_csv(matrix: DataFrame, terms: list[str], path: str) -> None:
    """A square CSV folder: terms in order as header and rows, four decimals."""
    require_rows(matrix, "matrix")
    wide = matrix.groupBy(F.col("t1").alias("term")).pivot("t2", sorted(terms)).agg(F.first("score"))
    shown = wide.select("term", *[F.format_string("%.4f", F.coalesce(F.col(f"`{t}`"), F.lit(0.0))).alias(t) for t in sorted(terms)])
    shown.orderBy("term").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_terms(terms: DataFrame, path: str, format: str = "json", fields: list[str] | None = None) -> int:
    """Terms in alphabetical order; the number written."""
    require_rows(terms, "term list")
    ordered = terms.orderBy("term").coalesce(1)
    if format == "txt":
        ordered.select("term").write.mode("overwrite").text(path)
    elif format == "csv":
        wanted = fields or ["term", "lemma", "pos", "definition", "notes"]
        ordered.select(*[F.array_join(c, "; ").alias(c) if c == "examples" else F.col(c) for c in wanted]).write.mode("overwrite").option("header", True).csv(path)
    elif format == "json":
        ordered.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {format!r}: txt, csv or json")
    return terms.count()


# What a link says.
PHRASES = {"cooccurrence": "co-occurs with", "svo": "relates to", "copular": "is", "prep": "relates to"}


def node_sizes(g: graphs.ConceptGraph, size_by: str = "frequency") -> DataFrame:
    """(id, size): the frequency, or degree or betweenness scaled to 1..20."""
    if size_by == "frequency":
        return g.nodes.select("id", F.coalesce(F.col("frequency").cast("double"), F.lit(1.0)).alias("size"))
    if size_by not in ("degree", "betweenness"):
        return g.nodes.select("id", F.lit(1.0).alias("size"))
    raw = g.degrees().select("id", F.col("degree").cast("double").alias("score")) if size_by == "degree" else metrics.betweenness(g)
    ends = F.broadcast(raw.agg(F.min("score").alias("low"), F.max("score").alias("high")))  # one row
    return raw.join(ends).select("id", F.when(F.col("high") > F.col("low"), 1 + 19 * (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("score")).alias("size"))


def d3(g: graphs.ConceptGraph, include_evidence: bool = False, size_by: str = "frequency", with_communities: bool = True, max_evidence: int = 3) -> dict:
    """Nodes and links for a force layout; equal labels are one node, isolated nodes go."""
    g = graphs.consolidated(g)
    alone = graphs.isolated(g).select("id")
    g = graphs.ConceptGraph(g.nodes.join(alone, "id", "left_anti"), g.edges, g.directed)
    if g.nodes.count() + g.edges.count() > FILE_ITEMS:
        raise ValueError(f"more than {FILE_ITEMS} nodes and edges: write tables instead")
    group = metrics.communities(g) if with_communities else g.nodes.select("id", F.lit(0).alias("community"))
    nodes = g.nodes.join(node_sizes(g, size_by), "id", "left").join(group, "id", "left").orderBy("id").collect()  # checked above
    shown = [{"id": r.id, "label": r.label, "size": r.size, "group": r.community, **{k: r[k] for k in ("frequency", "pos", "definition") if r[k] is not None}} for r in nodes]
    links = []
    for r in g.edges.orderBy("src", "dst").collect():
        link = {"source": r.src, "target": r.dst, "weight": 1.0 if r.weight is None else r.weight, "label": r.relation_type, "verb": PHRASES.get(r.relation_type, "relates to")}
        if include_evidence:
            link["evidence"] = list(r.evidence or [])[:max_evidence]
        links.append(link)
    return {"nodes": shown, "links": links}


def write_d3_json(g: graphs.ConceptGraph, path: str, **options) -> str:
    return _text(path, json.dumps(d3(require_graph(g), **options), ensure_ascii=False, indent=2))


def _collected(g: graphs.ConceptGraph) -> tuple[list[dict], list[dict]]:
    require_graph(g, edges=False)
    if g.nodes.count() + g.edges.count() > FILE_ITEMS:
        raise ValueError(f"more than {FILE_ITEMS} nodes and edges: write tables instead")
    rows = lambda df, *by: [{k: v for k, v in r.asDict().items() if v is not None} for r in df.orderBy(*by).collect()]
    return rows(g.nodes, "id"), rows(g.edges, "src", "dst")


def write_node_link_json(g: graphs.ConceptGraph, path: str) -> str:
    nodes, edges = _collected(g)
    links = [{"source": e.pop("src"), "target": e.pop("dst"), **e} for e in edges]
    return _text(path, json.dumps({"directed": g.directed, "multigraph": False, "graph": {}, "nodes": nodes, "links": links}, ensure_ascii=False, indent=2))


def _flat(v, mark: str) -> str:
    return mark.join(map(str, v)) if isinstance(v, list) else str(v)


def write_graphml(g: graphs.ConceptGraph, path: str) -> str:
    nodes, edges = _collected(g)
    kinds = {(w, k): "double" if isinstance(v, float) else "long" if isinstance(v, int) else "string" for w, rows in (("node", nodes), ("edge", edges)) for r in rows for k, v in r.items() if k not in ("id", "src", "dst")}
    keys = "".join(f'<key id="{w}_{k}" for="{w}" attr.name="{k}" attr.type="{t}"/>\n' for (w, k), t in sorted(kinds.items()))
    data = lambda w, r, mark: "".join(f'<data key="{w}_{k}">{escape(_flat(v, mark))}</data>' for k, v in sorted(r.items()) if k not in ("id", "src", "dst"))
    body = "".join(f"<node id={quoteattr(n['id'])}>{data('node', n, ', ')}</node>\n" for n in nodes)
    body += "".join(f"<edge source={quoteattr(e['src'])} target={quoteattr(e['dst'])}>{data('edge', e, ' | ')}</edge>\n" for e in edges)
    way = "directed" if g.directed else "undirected"
    return _text(path, f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{keys}<graph edgedefault="{way}">\n{body}</graph>\n</graphml>\n')


def write_gexf(g: graphs.ConceptGraph, path: str) -> str:
    """Every attribute of nodes and edges is declared and written; lists are joined."""
    nodes, edges = _collected(g)
    own = {"node": ("id", "label"), "edge": ("src", "dst", "weight")}

    def parts(kind: str, rows: list[dict], mark: str) -> tuple[str, list[str]]:
        kinds = {k: "double" if isinstance(v, float) else "long" if isinstance(v, int) else "string" for r in rows for k, v in r.items() if k not in own[kind]}
        number = {k: i for i, k in enumerate(sorted(kinds))}
        declared = "".join(f'<attribute id="{i}" title={quoteattr(k)} type="{kinds[k]}"/>\n' for k, i in number.items())
        values = ["".join(f'<attvalue for="{number[k]}" value={quoteattr(_flat(v, mark))}/>' for k, v in sorted(r.items()) if k in number) for r in rows]
        return f'<attributes class="{kind}">\n{declared}</attributes>\n' * bool(kinds), [f"<attvalues>{v}</attvalues>" * bool(v) for v in values]

    (node_kinds, node_values), (edge_kinds, edge_values) = parts("node", nodes, ", "), parts("edge", edges, " | ")
    body = "".join(f"<node id={quoteattr(n['id'])} label={quoteattr(n.get('label', n['id']))}>{v}</node>\n" for n, v in zip(nodes, node_values, strict=True))
    links = "".join(f'<edge id="{i}" source={quoteattr(e["src"])} target={quoteattr(e["dst"])} weight="{e.get("weight", 1.0)}" label={quoteattr(e.get("relation_type", ""))}>{v}</edge>\n' for i, (e, v) in enumerate(zip(edges, edge_values, strict=True)))
    way = "directed" if g.directed else "undirected"
    return _text(path, f'<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="{way}" mode="static">\n{node_kinds}{edge_kinds}<nodes>\n{body}</nodes>\n<edges>\n{links}</edges>\n</graph>\n</gexf>\n')


def write_dot(g: graphs.ConceptGraph, path: str, layout: str = "dot") -> str:
    nodes, edges = _collected(g)
    q = lambda s: json.dumps(str(s), ensure_ascii=False)
    arrow, kind = ("->", "digraph") if g.directed else ("--", "graph")
    lines = [f"{kind} concepts {{", f"  layout={layout};", *(["  rankdir=LR;"] if g.directed else [])]
    lines += [f"  {q(n['id'])} [label={q(n.get('label', n['id']))}];" for n in nodes]
    lines += [f"  {q(e['src'])} {arrow} {q(e['dst'])} [label={q(e.get('relation_type', ''))}, weight={e.get('weight', 1.0)}];" for e in edges]
    return _text(path, "\n".join([*lines, "}", ""]))


def write_graph_csv(g: graphs.ConceptGraph, path: str) -> None:
    """Folders nodes and edges of CSV files; lists joined by ``; ``."""
    require_graph(g, edges=False)
    g.nodes.orderBy("id").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges = g.edges.withColumn("evidence", F.array_join("evidence", "; ")).withColumnsRenamed({"src": "source", "dst": "target"})
    edges.orderBy("source", "target").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title><style>body{{margin:0;font-family:sans-serif}}circle{{stroke:#fff}}line{{stroke:#999}}</style></head>
<body><h1>{title}</h1><svg id="graph" width="{width}" height="{height}"></svg>
<script>
const data = {data};
const svg = document.getElementById("graph"), ns = "http://www.w3.org/2000/svg", W = {width}, H = {height};
const at = new Map(data.nodes.map((n, i) => [n.id, {{x: W / 2 + W / 3 * Math.cos(6.283 * i / data.nodes.length), y: H / 2 + H / 3 * Math.sin(6.283 * i / data.nodes.length), n}}]));
for (let round = 0; round < 200; round++) {{
  const all = [...at.values()];
  for (const a of all) {{ a.fx = (W / 2 - a.x) * 0.01; a.fy = (H / 2 - a.y) * 0.01; for (const b of all) {{ const dx = a.x - b.x, dy = a.y - b.y, d = dx * dx + dy * dy + 1; a.fx += 400 * dx / d; a.fy += 400 * dy / d; }} }}
  for (const l of data.links) {{ const a = at.get(l.source), b = at.get(l.target), dx = b.x - a.x, dy = b.y - a.y; a.fx += dx * 0.02; a.fy += dy * 0.02; b.fx -= dx * 0.02; b.fy -= dy * 0.02; }}
  for (const a of all) {{ a.x += Math.max(-9, Math.min(9, a.fx)); a.y += Math.max(-9, Math.min(9, a.fy)); }}
}}
const make = (name, values, text) => {{ const e = document.createElementNS(ns, name); for (const k in values) e.setAttribute(k, values[k]); if (text) e.textContent = text; svg.appendChild(e); return e; }};
for (const l of data.links) {{ const a = at.get(l.source), b = at.get(l.target); make("line", {{x1: a.x, y1: a.y, x2: b.x, y2: b.y}}).appendChild(document.createElementNS(ns, "title")).textContent = l.verb; }}
for (const p of at.values()) {{ make("circle", {{cx: p.x, cy: p.y, r: 4 + Math.sqrt(p.n.size || 1), fill: "hsl(" + 47 * (p.n.group || 0) % 360 + ",60%,55%)"}}); make("text", {{x: p.x + 8, y: p.y, "font-size": 11}}, p.n.label); }}
</script></body></html>
"""


def write_html(g: graphs.ConceptGraph, folder: str, title: str = "Concept Network", width: int = 1200, height: int = 800, include_evidence: bool = False) -> str:
    """A folder with graph_data.json and an index.html that needs nothing else."""
    data = json.dumps(d3(require_graph(g), include_evidence=include_evidence), ensure_ascii=False)
    _text(os.path.join(folder, "graph_data.json"), data)
    return _text(os.path.join(folder, "index.html"), _PAGE.format(title=escape(title), width=width, height=height, data=data.replace("</", "<\\/")))
