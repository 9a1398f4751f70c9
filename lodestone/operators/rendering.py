"""Results as Markdown for a language model. Rows become text by column expressions; the
texts of one result (a bounded list) are joined in order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators.ranking import display_order, first_of_each

# Labels in the two languages.
UI = {
    "concept_header": {"th": "## แนวคิดหลัก", "en": "## Key Concepts"},
    "hardware_header": {"th": "## ฮาร์ดแวร์", "en": "## Hardware"},
    "strategy_header": {"th": "## กลยุทธ์", "en": "## Strategies"},
    "narrative_header": {"th": "## เรื่องราวเชิงบรรยาย", "en": "## Narratives"},
    "other_header": {"th": "## ข้อมูลเพิ่มเติม", "en": "## Additional Information"},
    "relationships_header": {"th": "## ความสัมพันธ์", "en": "## Relationships"},
    "domain": {"th": "**โดเมน:**", "en": "**Domain:**"},
    "description": {"th": "**คำอธิบายทางเทคนิค:**", "en": "**Technical Description:**"},
    "layman": {"th": "**คำอธิบายแบบง่าย:**", "en": "**Simple Explanation:**"},
    "analogy": {"th": "**อุปมา:**", "en": "**Analogy:**"},
    "fiction_seed": {"th": "**แนวคิดสร้างสรรค์:**", "en": "**Creative Seed:**"},
    "visual_concept": {"th": "**ภาพเชิงแนวคิด:**", "en": "**Visual Concept:**"},
    "no_results": {"th": "> **ไม่พบผลลัพธ์** — ไม่มีข้อมูลที่จะแสดง", "en": "> **No results** — nothing to display"},
}
# Names of relationship types.
RELATIONS = {
    "relates_to": {"th": "เกี่ยวข้องกับ", "en": "relates to"},
    "depends_on": {"th": "ขึ้นอยู่กับ", "en": "depends on"},
    "part_of": {"th": "เป็นส่วนหนึ่งของ", "en": "is part of"},
    "contrasts_with": {"th": "ตรงข้ามกับ", "en": "contrasts with"},
    "causes": {"th": "ทำให้เกิด", "en": "causes"},
    "supports": {"th": "สนับสนุน", "en": "supports"},
    "conflicts_with": {"th": "ขัดแย้งกับ", "en": "conflicts with"},
    "similar_to": {"th": "คล้ายกับ", "en": "similar to"},
}
# Headings and messages of search results.
RESULTS, EMPTY_QUERY, NO_MATCH = "# Search Results", "> **Empty query provided.** Please provide a search term.", "> No results matched your query. Try rephrasing or using different keywords."
EMPTY_RESPONSE = f"{RESULTS}\n\n{EMPTY_QUERY}"
TOOL = "search_knowledge_graph"
SECTIONS = {"KnowledgeConcept": "concept_header", "Hardware": "hardware_header", "Strategy": "strategy_header", "Narrative": "narrative_header"}
ABSENT = "N/A"


def label(key: str, language: str) -> str:
    return UI[key].get(language, key)


def joined(text: Column, pos: Column, sep: str) -> Column:
    """Aggregate: texts of a group in the order of ``pos``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), text.alias("t")))), lambda x: x["t"]), sep)


def _text(name: str, df: DataFrame) -> Column:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def context_block(vectors: DataFrame, expanded: DataFrame, by: str = "query") -> DataFrame:
    """(query, context_block, total_nodes): nodes of both tables once each, vector results
    first; scored ones by falling score, then the others as they came."""
    rows = vectors.withColumn("src", F.lit(0)).unionByName(expanded.withColumn("src", F.lit(1)), allowMissingColumns=True).withColumn("pos", F.struct("src", "pos"))
    rows = first_of_each(rows.withColumn("key", F.concat_ws("\x1f", by, "id")).where("id is not null and id <> ''"), "key")
    from pyspark.sql import Window

    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(*display_order(), F.col("id"))))
    th, en = _text("name_th", rows), _text("name_en", rows)
    name = F.when(th.isNotNull() & en.isNotNull(), F.concat(th, F.lit(" ("), en, F.lit(")"))).otherwise(F.coalesce(th, en, F.col("id")))
    score = F.when(F.col("score") > 0, F.concat(F.lit("Relevance: "), F.format_string("%.4f", F.col("score"))))
    hops = F.concat(F.lit("Hops: "), F.col("hops").cast("string")) if "hops" in rows.columns else F.lit(None).cast("string")
    meta = F.nullif(F.concat_ws(" | ", score, hops), F.lit(""))
    field = lambda title, c: F.concat(F.lit(f"**{title}:** "), _text(c, rows), F.lit("\n"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col("idx").cast("string"), F.lit(". "), name), F.concat(F.lit("*Type: "), _text("label", rows), F.lit("*\n")), F.concat(F.lit("📊 "), meta, F.lit("\n")),
        field("Simple Explanation", "layman_explanation"), field("Analogy", "analogy"), field("Creative Seed", "fiction_seed"), F.lit("---\n"),
    )
    blocks = rows.select(by, "idx", block.alias("block"))
    return blocks.groupBy(by).agg(F.concat(F.lit(f"{RESULTS}\n\n"), joined(F.col("block"), F.col("idx"), "\n")).alias("context_block"), F.count("*").alias("total_nodes"))


def concept_block(df: DataFrame, language: str = "th", creative: bool = True) -> Column:
    """A node as Markdown. A missing value is N/A; an empty one stays empty."""
    first, second = ("name_th", "name_en") if language == "th" else ("name_en", "name_th")
    told = lambda c: F.coalesce(F.col(c), F.lit(ABSENT)) if c in df.columns else F.lit(ABSENT)
    rows = [("domain", "domain"), ("description", f"technical_desc_{'th' if language == 'th' else 'en'}"), ("layman", "layman_explanation")]
    if creative:
        rows += [(c, c) for c in ("analogy", "fiction_seed", "visual_concept")]
    return F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(_text(first, df), _text(second, df), F.col("id"), F.lit(ABSENT))), *[F.concat(F.lit(label(k, language) + " "), told(c)) for k, c in rows])


def relationships(rels: DataFrame, language: str = "th", by: str | None = None) -> DataFrame:
    """(block): relationships (pos, type, source, target) grouped by type as they first come."""
    keys = [by] if by else []
    name = F.col("type")
    for kind, names in RELATIONS.items():
        name = F.when(F.col("type") == kind, F.lit(names.get(language, names["en"]))).otherwise(name)
    line = F.concat(F.lit("- "), F.coalesce("source", F.lit("…")), F.lit(" → "), F.coalesce("target", F.lit("…")))
    rows = rels.withColumn("type", F.coalesce("type", F.lit("unknown"))).withColumn("name", name if not isinstance(name, str) else F.col("type")).withColumn("line", line)
    groups = rows.groupBy(*keys, "type", "name").agg(F.min("pos").alias("pos"), joined(F.col("line"), F.col("pos"), "\n").alias("lines"))
    text = F.concat(F.lit("**"), "name", F.lit(":**\n\n"), "lines", F.lit("\n"))
    head = f"### {label('relationships_header', language)}\n\n"
    return groups.groupBy(*keys).agg(F.concat(F.lit(head), joined(text, F.col("pos"), "\n")).alias("block"))


def assemble(nodes: DataFrame, language: str = "th", creative: bool = True, by: str = "query", rels: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(query, context): nodes (pos, id, label, ...) once each, in sections by label, known
    ones first, others by name; in a section by score; then relationships (query, pos, type,
    source, target) if there are any. Queries of ``asked`` that have neither get the text
    that says so."""
    rows = first_of_each(nodes.withColumn("key", F.concat_ws("\x1f", by, "id")).where("id is not null and id <> ''"), "key")
    rows = rows.withColumn("label", F.coalesce("label", F.lit("Other")))
    scored = F.coalesce(F.col("score") > 0, F.lit(False))
    order = F.struct((~scored).alias("u"), F.when(scored, -F.col("score")).alias("s"), F.col("pos"))
    sections = rows.withColumn("block", concept_block(rows, language, creative)).groupBy(by, "label").agg(joined(F.concat("block", F.lit("\n")), order, "\n").alias("blocks"))
    rank, head = F.lit(len(SECTIONS)), F.lit(label("other_header", language))
    for k, (name, key) in enumerate(SECTIONS.items()):
        rank, head = F.when(F.col("label") == name, k).otherwise(rank), F.when(F.col("label") == name, F.lit(label(key, language))).otherwise(head)
    text = F.concat(head, F.lit("\n\n"), "blocks")
    out = sections.groupBy(by).agg(joined(text, F.struct(rank.alias("r"), F.col("label")), "\n\n").alias("context"))
    if rels is not None:
        out = out.join(relationships(rels, language, by), by, "full_outer").select(by, F.concat_ws("\n\n", "context", "block").alias("context"))
    if asked is not None:
        out = asked.select(by).distinct().join(out, by, "left").withColumn("context", F.coalesce("context", F.lit(label("no_results", language))))
    return out


def no_results(query: Column) -> Column:
    return F.concat(F.lit('> **No results found** for query: "'), query, F.lit('"\n> Vector search returned zero matching nodes.\n'))


def no_valid_nodes(query: Column) -> Column:
    return F.concat(F.lit('> **No valid nodes** for query: "'), query, F.lit('"\n> Vector search returned results but none contained a node ID.\n'))


def tool_response(query: Column, total: Column, block: Column) -> Column:
    """A search tool's answer; blank queries are told so."""
    asked = F.trim(query)
    head = F.concat(F.lit(f'{RESULTS} for: "'), asked, F.lit('"\n\n**Found '), F.coalesce(total, F.lit(0)).cast("string"), F.lit(" related nodes**\n\n"))
    body = F.coalesce(F.nullif(block, F.lit("")), F.lit(f"{NO_MATCH}\n"))
    return F.when(F.coalesce(asked, F.lit("")) == "", F.lit(EMPTY_RESPONSE)).otherwise(F.concat(head, body))


def tool_text(query: str, total: int, block: str) -> str:
    """The same of one search."""
    return f'{RESULTS} for: "{query}"\n\n**Found {total} related nodes**\n\n' + (block or f"{NO_MATCH}\n")


def tool_timeout(query: str, seconds: float) -> str:
    return f'{RESULTS} for: "{query}"\n\n> ⏱ **Search timed out.** The query took longer than {seconds:g} seconds. Please try a shorter or more specific query.\n'


def tool_error(query: str, message: str, most: int = 500) -> str:
    told = message if len(message) <= most else message[: most - 3] + "..."
    return f'{RESULTS} for: "{query}"\n\n> ❌ **Search error:** {told}\n'


def unknown_tool(name: str) -> str:
    return f'# Tool Error\n\n> Unknown tool: "{name}"'


def short_message(message: Column, most: int = 500) -> Column:
    return F.when(F.char_length(message) > most, F.concat(F.substring(message, 1, most - 3), F.lit("..."))).otherwise(message)


def tool_schema() -> str:
    """JSON description of the search tool."""
    told = {"type": "string", "description": "What to look for, in Thai or English."}
    return json.dumps({"type": "function", "function": {"name": TOOL, "description": "Search documents by vectors and their graph.", "parameters": {"type": "object", "properties": {"search_query": told}, "required": ["search_query"]}}})
