"""Structure of Markdown texts as column expressions, and a plain HTML converter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone.functions.text import once, strip

# Patterns of the Markdown that is understood, and of key terms.
HEADING = r"(?d)^(#{1,6})\s+(.+)$"
FENCE = r"(?s)```(\w*)\s*\n(.*?)```"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
TITLE = r"(?md)^#\s+(.+)$"
PROPER = r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*)\b"
WORD = r"(?U)\b([a-zA-Z]{4,})\b"
#: Words that Thai key terms leave out.
THAI_STOP = (
    "ที่", "เป็น", "มี", "ใน", "และ", "ของ", "จะ", "ได้", "ก็", "กับ", "จาก", "ถึง", "สำหรับ", "โดย", "ไม่",
    "แต่", "หรือ", "ยัง", "สามารถ", "นี้", "นั้น", "ซึ่ง", "มา", "ไป", "ทำ", "เช่น", "เมื่อ", "ถ้า", "เพราะ",
)
#: HTML to Markdown, in order: pattern and replacement.
HTML_STEPS = (
    (r"(?is)<(script|style|head|title)\b.*?</(script|style|head|title)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<h1[^>]*>", "\n# "), (r"(?i)<h2[^>]*>", "\n## "), (r"(?i)<h3[^>]*>", "\n### "),
    (r"(?i)</h[1-6]>|</p>|</div>|</li>|<br[^>]*>", "\n"),
    (r"(?i)<li[^>]*>", "- "),
    (r"""(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"(?s)<[^>]*>", ""),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"),
    (r"\n{3,}", "\n\n"),
)


def from_html(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern, to in HTML_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def lines(content: Column) -> Column:
    return F.split(content, "\n")


def title(content: Column) -> Column:
    found = strip(F.regexp_extract(content, TITLE, 1))
    return F.when(found == "", F.lit("Untitled Document")).otherwise(F.coalesce(found, F.lit("Untitled Document")))


def links(content: Column) -> Column:
    """array<struct<text, url>>; images match too."""
    texts, urls = (F.regexp_extract_all(content, F.lit(LINK), F.lit(k)) for k in (1, 2))
    return F.zip_with(texts, urls, lambda t, u: F.struct(t.alias("text"), u.alias("url")))


def code_blocks(content: Column) -> Column:
    """array<struct<language, code>> of fenced blocks."""
    kinds, codes = (F.regexp_extract_all(content, F.lit(FENCE), F.lit(k)) for k in (1, 2))
    return F.zip_with(kinds, codes, lambda k, c: F.struct(F.when(k == "", F.lit("unknown")).otherwise(k).alias("language"), strip(c).alias("code")))


def frequent(words: Column, least: int) -> Column:
    """Words that occur ``least`` times or more, by first occurrence. In sorted order equal
    words are neighbours, so a run tells its length at its first word."""

    def runs(x: Column) -> Column:
        return F.filter(x, lambda w, i: F.equal_null(F.get(x, i + least - 1), w) & ~F.equal_null(F.get(x, i - 1), w))

    return F.coalesce(once(words, lambda x: F.array_intersect(x, once(F.sort_array(x), runs))), F.array().cast("array<string>"))


def key_terms(content: Column, most: int = 50) -> Column:
    """Capitalised phrases, then words of four letters or more that occur three times,
    each once, by first occurrence, at most ``most``."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?s)```.*?```", ""), "`[^`]*`", "")
    proper = F.regexp_extract_all(clean, F.lit(PROPER), F.lit(1))
    words = frequent(F.regexp_extract_all(F.lower(clean), F.lit(WORD), F.lit(1)), 3)
    return F.slice(F.array_distinct(F.concat(proper, F.slice(words, 1, most))), 1, most)


def thai_key_terms(tokens: Column, most: int = 50) -> Column:
    """Key terms of tokenised Thai: not stop words, over two characters, twice or more."""
    kept = F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(*THAI_STOP))
    return F.slice(frequent(kept, 2), 1, most)


def front_matter(content: Column, domain: Column, language: Column, source: Column, processed: str) -> Column:
    """Content with a YAML head, unless it has one."""
    head = F.concat(F.lit("---\ndomain: "), domain, F.lit("\nlanguage: "), language, F.lit("\nsource_pdf: "), source, F.lit(f"\nprocessed_date: {processed}\n---\n\n"))
    return F.when(content.rlike(r"(?s)^---\s*\n.*?\n---\s*\n"), content).otherwise(F.concat(head, content))


def auto_key_terms(content: Column, thai_tokens: Column | None = None, most: int = 50) -> Column:
    """Thai key terms where Thai is over a tenth of what is no space, if tokens are given."""
    if thai_tokens is None:
        return key_terms(content, most)
    share = F.regexp_count(content, F.lit(r"[\x{0E00}-\x{0E7F}]")) / F.nullif(F.char_length(F.regexp_replace(content, "[ \n]", "")), F.lit(0))
    return F.when(F.coalesce(share, F.lit(0.0)) > 0.1, thai_key_terms(thai_tokens, most)).otherwise(key_terms(content, most))
