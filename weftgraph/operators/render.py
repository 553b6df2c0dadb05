"""Rendering: diagrams of bindings, documents, JSON."""

from __future__ import annotations

import html
import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.paths import base_name


def to_json(df: DataFrame) -> DataFrame:
    """One column ``value`` with a JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def diagram_lines(connections: DataFrame) -> DataFrame:
    """``workspace, line_no, line``: for each workspace the text of a flow chart of its connections.

    ``connections`` has ``workspace, kind, key, cross_repo, client_path, server_path,
    client_root, server_root``.  Artifacts are nodes in one box per root, named by their file
    name and numbered by path; ``==>`` crosses roots, ``-->`` stays within one.  Nodes are
    numbered per workspace.
    """
    ends = F.array(F.struct(F.col("client_root").alias("root"), F.col("client_path").alias("path")), F.struct(F.col("server_root").alias("root"), F.col("server_path").alias("path")))
    nodes = connections.select("workspace", F.inline(ends)).distinct().withColumn("root", F.coalesce(base_name(F.col("root")), F.lit("external")))
    nodes = nodes.groupBy("workspace", "path").agg(F.min("root").alias("root")).withColumn("node", F.concat(F.lit("n"), (F.row_number().over(Window.partitionBy("workspace").orderBy("path")) - 1).cast("string")))
    ids = nodes.select("workspace", "path", "node")
    arrows = (
        connections.join(ids.toDF("workspace", "client_path", "a"), ["workspace", "client_path"]).join(ids.toDF("workspace", "server_path", "b"), ["workspace", "server_path"])
        .select("workspace", F.lit(3).alias("part"), F.lit("").alias("box"), F.concat_ws("", F.lit("  "), "a", F.when(F.col("cross_repo") == 1, " ==>").otherwise(" -->"), F.lit('|"'), T.safe_label(F.concat_ws(" ", "kind", "key")), F.lit('"| '), "b").alias("line")).distinct()
    )
    heads = connections.select("workspace").distinct().select("workspace", F.lit(0).alias("part"), F.lit("").alias("box"), F.lit("flowchart LR").alias("line"))
    mark = F.regexp_replace("root", "[^A-Za-z0-9_]", "_")
    boxes = nodes.groupBy("workspace", "root").agg(F.array_sort(F.collect_list(F.concat_ws("", F.lit("    "), "node", F.lit('["'), T.safe_label(base_name(F.col("path"))), F.lit('"]')))).alias("rows"))
    boxed = boxes.select("workspace", F.lit(1).alias("part"), F.col("root").alias("box"), F.posexplode(F.concat(F.array(F.concat_ws("", F.lit("  subgraph "), mark, F.lit('["'), T.safe_label(F.col("root")), F.lit('"]'))), F.col("rows"), F.array(F.lit("  end")))).alias("k", "line"))
    rows = heads.withColumn("k", F.lit(0)).unionByName(boxed).unionByName(arrows.withColumn("k", F.lit(0)))
    order = Window.partitionBy("workspace").orderBy("part", "box", "k", "line")
    return rows.select("workspace", F.row_number().over(order).cast("long").alias("line_no"), "line")


def diagram(connections: DataFrame, workspace: str) -> str:
    """The flow chart of one workspace as text; a fixed text if there is nothing to draw."""
    rows = diagram_lines(connections.where(F.col("workspace") == workspace)).orderBy("line_no").collect()
    return "\n".join(r.line for r in rows) if rows else 'flowchart LR\n  empty["no connections found"]'


_STYLE = "body{font-family:sans-serif;max-width:52rem;margin:2rem auto;line-height:1.5}pre,code{background:#f4f4f4}pre{padding:.8rem;overflow:auto}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3rem .6rem}"


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    out = re.sub(r"`([^`]+)`", r"<code>\1</code>", out)
    out = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", out)
    return re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', out)


def markdown_html(text: str) -> str:
    """HTML of the usual subset of Markdown: headings, lists, quotes, tables, fences and inline marks.

    Diagrams in ``mermaid`` fences are passed through for the browser to draw.
    """
    out: list[str] = []
    lines, k = text.split("\n"), 0
    while k < len(lines):
        line = lines[k]
        if line.startswith("```"):
            kind, body = line[3:].strip(), []
            k += 1
            while k < len(lines) and not lines[k].startswith("```"):
                body.append(lines[k])
                k += 1
            inner = "\n".join(body)
            out.append(f'<div class="mermaid">\n{inner}\n</div>' if kind == "mermaid" else f"<pre><code>{html.escape(inner, quote=False)}</code></pre>")
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{_inline(m[2].strip())}</h{len(m[1])}>")
        elif re.match(r"\s*[-*]\s+", line) or re.match(r"\s*\d+\.\s+", line):
            tag = "ol" if re.match(r"\s*\d", line) else "ul"
            items = []
            while k < len(lines) and (m := re.match(r"\s*(?:[-*]|\d+\.)\s+(.*)", lines[k])):
                items.append(f"<li>{_inline(m[1])}</li>")
                k += 1
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
            continue
        elif line.startswith("|") and k + 1 < len(lines) and re.match(r"\|[\s:|-]+\|?\s*\Z", lines[k + 1]):
            rows = []
            cells = lambda s: [_inline(c.strip()) for c in s.strip().strip("|").split("|")]
            rows.append("<tr>" + "".join(f"<th>{c}</th>" for c in cells(line)) + "</tr>")
            k += 2
            while k < len(lines) and lines[k].startswith("|"):
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[k])) + "</tr>")
                k += 1
            out.append(f"<table>{''.join(rows)}</table>")
            continue
        elif line.startswith(">"):
            out.append(f"<blockquote>{_inline(line[1:].strip())}</blockquote>")
        elif line.strip():
            body = [line]
            while k + 1 < len(lines) and lines[k + 1].strip() and not re.match(r"(```|#{1,6}\s|\s*[-*]\s|\s*\d+\.\s|\||>)", lines[k + 1]):
                k += 1
                body.append(lines[k])
            out.append(f"<p>{_inline(' '.join(body))}</p>")
        k += 1
    return "\n".join(out)


def document_html(title: str, body: str, subtitle: str = "", when: datetime | None = None) -> str:
    """A page of its own from Markdown."""
    when = when or datetime.now()
    name = html.escape(title.strip(), quote=False)
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{name}</title><style>{_STYLE}</style></head>\n<body><h1>{name}</h1><p>{html.escape(subtitle, quote=False)}</p>\n{markdown_html(body)}\n<p><small>{when:%Y-%m-%d %H:%M}</small></p></body></html>'


def write_document(folder: str | Path, workspace: str, title: str, body: str, subtitle: str = "", when: datetime | None = None) -> Path:
    """Write the page to ``folder`` under a name made of workspace, title and time."""
    when = when or datetime.now()
    name = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:60] or "artifact"
    path = Path(folder) / f"{workspace}-{name}-{when:%Y%m%d-%H%M%S}.html"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(document_html(title, body, subtitle, when), "utf-8")
    return path
