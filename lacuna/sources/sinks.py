"""Writers: JSON lines, CSV with nested values as JSON, graph exports."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in rows.dtypes])


def csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", True).csv(path)


def union_csv(tables: list[DataFrame], path: str) -> None:
    """Tables of different columns under one header: their union, in order of first appearance."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    csv(out, path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, CSV and JSON lines, and counts by type; edges are partitioned by relation for pruned reads."""
    from lacuna.operators.graph import type_summary

    json_lines(nodes, f"{path}/nodes_json")
    json_lines(edges, f"{path}/edges_json")
    csv(type_summary(nodes, "type").coalesce(1), f"{path}/node_type_summary")
    csv(type_summary(edges, "relation").coalesce(1), f"{path}/edge_type_summary")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    csv(nodes, f"{path}/nodes_csv")
    csv(edges, f"{path}/edges_csv")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graphml(nodes: DataFrame, edges: DataFrame, limit: int) -> str:
    """GraphML of the ``limit`` nodes of highest degree and the edges among them."""
    from lacuna.operators.graph import degree_top, induced

    top = degree_top(edges, limit)
    some = nodes.join(F.broadcast(top.select("id")), "id").select("id", "type", "label").orderBy("id").collect()  # limit rows
    ends = induced(edges, top).select("source", "target", "relation").distinct().orderBy("source", "target", "relation").collect()  # limit^2 times the relations
    out = ['<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">']
    out += [f'<node id={quoteattr(r["id"])}><data key="type">{escape(r["type"])}</data><data key="label">{escape(r["label"])}</data></node>' for r in some]
    out += [f'<edge source={quoteattr(r["source"])} target={quoteattr(r["target"])}><data key="relation">{escape(r["relation"])}</data></edge>' for r in ends]
    return "\n".join([*out, "</graph></graphml>"])


def graph_html(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A page that lists the ``limit`` nodes of highest degree and the edges among them."""
    from html import escape as safe

    from lacuna.operators.graph import degree_top, induced

    top = degree_top(edges, limit)
    some = nodes.join(F.broadcast(top), "id").select("id", "type", "label", "degree").orderBy(F.desc("degree"), "id").collect()  # limit rows
    ends = induced(edges, top).select("source", "target", "relation").distinct().orderBy("source", "target", "relation").collect()
    rows = "".join(f"<tr id='{safe(r['id'], True)}'><td>{safe(r['type'])}</td><td>{safe(r['label'])}</td><td>{r['degree']}</td></tr>" for r in some)
    links = "".join(f"<li><a href='#{safe(r['source'], True)}'>{safe(r['source'])}</a> {safe(r['relation'])} <a href='#{safe(r['target'], True)}'>{safe(r['target'])}</a></li>" for r in ends)
    return f"<!DOCTYPE html><html><body><table>{rows}</table><ul>{links}</ul></body></html>"


def family_report(families: list[dict], title: str = "Project families") -> dict[str, str]:
    """A report of families as Markdown and HTML: by tier, without internal labels; caveats as sentences."""
    from html import escape as safe

    names = {1: "Read first", 2: "Promising after reframing", 3: "Lower priority"}
    md = [f"# {title}", ""]
    for tier, name in names.items():
        found = [f for f in families if f.get("tier") == tier]
        md += [f"## {name}", ""] + (["None."] if not found else [])
        for f in found:
            md += [f"### {f['family_title']}", "", f.get("problem_statement", ""), "", f"Caveats: {f.get('caveats', '')}", "", f"Papers: {', '.join(f.get('supporting_papers', []))}", ""]
    text = "\n".join(md) + "\n"
    body = "".join(f"<h{len(x) - len(x.lstrip('#'))}>{safe(x.lstrip('# '))}</h{len(x) - len(x.lstrip('#'))}>" if x.startswith("#") else f"<p>{safe(x)}</p>" for x in md if x)
    return {"final_report.md": text, "final_report.html": f"<!DOCTYPE html><html><body>{body}</body></html>"}


def latex(rows: list[dict], columns: list[str], caption: str) -> str:
    """A small table; special characters are escaped."""
    safe = lambda x: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in str(x))
    body = [" & ".join(safe(r.get(c, "")) for c in columns) + r" \\" for r in rows]
    head = " & ".join(map(safe, columns)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{safe(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", head, r"\hline", *body, r"\end{tabular}", r"\end{table}"])


def generation(population: DataFrame, number: int, path: str) -> None:
    """A population as the snapshot of one generation; a generation written again replaces only itself."""
    rows = population.withColumn("generation", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(path)


def events(rows: DataFrame, path: str) -> None:
    """Appends events (type, payload columns) with the time of writing."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "type"])) if len(rows.columns) > 1 else F.lit("{}")
    rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("at"), "type", payload.alias("payload")).write.mode("append").json(path)


def failures(log: DataFrame) -> DataFrame:
    """The failures among logged events."""
    return log.where("type = 'failure'")


def report_rows(rows: DataFrame, always: list[str], optional: list[str]) -> DataFrame:
    """A report's rows: the columns it always has (null where missing), optional ones where there are any, nested values as JSON."""
    first = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in always]
    return flat(rows.select(*first, *[c for c in optional if c in rows.columns]))
