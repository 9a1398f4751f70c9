"""Language and domain of texts, model and voice choices, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lodestone.functions.text import once, strip

#: Code points that count as Thai, and as Latin (with the six signs between Z and a).
THAI, LATIN = "".join(map(chr, range(0x0E00, 0x0E80))), "".join(map(chr, range(0x41, 0x7B)))
# Keywords of each domain, in order of precedence.
DOMAIN_KEYWORDS = {
    "finance": ["trading", "strategy", "alpha", "quant", "portfolio", "risk", "market", "stock", "bond", "derivative"],
    "hardware": ["server", "ic", "latency", "fpga", "network", "cpu", "gpu", "memory", "cache"],
    "engineering": ["architecture", "system", "design", "pattern", "algorithm", "optimization"],
    "fiction": ["character", "plot", "story", "narrative", "chapter", "scene"],
}
# Domains that a model may answer.
MODEL_DOMAINS = ["finance", "hardware", "engineering", "fiction", "science", "technology", "mathematics", "medicine", "law", "general"]
# Dimensions of embedding models; others have DEFAULT_DIMENSIONS.
DIMENSIONS = {"all-MiniLM-L6-v2": 768, "bge-m3": 1024, "nomic-embed-text": 768}
DEFAULT_DIMENSIONS = 1024


def half_even(x: Column, digits: int = 2) -> Column:
    """x rounded to ``digits`` (7 at most) decimals by its exact binary value, exact halves to
    the even one: what Python's ``round`` gives. Spark's own round the shortest decimal that
    reads back as x. For |x| * 10**digits below 2**50; others, nan and infinities stay.

    x splits into two doubles of half its bits, whose products with 2 * 10**digits are exact,
    so it is compared exactly with the points midway between candidates."""
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    unit, size = float(10**digits), F.abs(x)

    def told(a: Column) -> Column:
        shifted = a * 134217729.0
        high = shifted - (shifted - a)
        return once(F.struct(high.alias("high"), (a - high).alias("low"), F.floor(a * unit + 0.5).cast("double").alias("k")), near)

    def near(c: Column) -> Column:
        beyond = lambda m: (c["high"] * (2 * unit) - m) + c["low"] * (2 * unit)  # noqa: E731  of 2 * unit * x and m
        below, above, even = beyond(2 * c["k"] - 1), beyond(2 * c["k"] + 1), c["k"] % 2 == 0
        k = F.when((below < 0) | ((below == 0) & ~even), c["k"] - 1).when((above > 0) | ((above == 0) & ~even), c["k"] + 1).otherwise(c["k"])
        return k / unit

    good = size * unit < float(1 << 50)
    return F.when(good, F.when(x < 0, -1.0).otherwise(1.0) * once(size, told)).otherwise(x)


def language(text: Column) -> Column:
    """struct<language, confidence>: Thai, Latin or mixed, and the share of such characters."""
    # what a translation to nothing takes away: one pass, no matcher
    thai, latin = (F.char_length(text) - F.char_length(F.translate(text, chars, "")) for chars in (THAI, LATIN))

    def told(c: Column) -> Column:
        share = F.least(F.lit(1.0), half_even((c["thai"] + c["latin"]) / c["n"]))
        code = F.when((c["thai"] > 0) & (c["latin"] > 0), "mixed").when(c["thai"] > 0, "th").otherwise("en")
        confidence = F.when(F.coalesce(c["n"], F.lit(0)) == 0, F.lit(0.0)).when(c["thai"] + c["latin"] == 0, F.lit(0.1)).otherwise(share)
        return F.struct(F.coalesce(code, F.lit("en")).alias("language"), confidence.alias("confidence"))

    return once(F.struct(thai.alias("thai"), latin.alias("latin"), F.char_length(strip(text)).alias("n")), told)


#: Confidence of a domain that a model names.
MODEL_CONFIDENCE = 0.8


def domain(text: Column, mode: str = "auto", manual: str | None = None, answer: Column | None = None) -> Column:
    """struct<domain, confidence>: the domain of which most keywords occur in the text, the
    first of equals; "manual" gives the one named; "llm" the one in a model's ``answer``,
    with MODEL_CONFIDENCE, or where that is null, as after a failed call, that of "auto".
    Blank texts are general, with confidence 0, in every mode."""
    if mode not in ("auto", "manual", "llm"):
        raise ValueError(f"domain mode {mode}")
    told = lambda d, c: F.struct(F.lit(d).alias("domain"), F.lit(float(c)).alias("confidence"))
    blank = text.isNull() | (strip(text) == "")
    if mode == "manual":
        return F.when(blank, told("general", 0)).otherwise(told(manual or "general", 1))

    def hits(low: Column) -> Column:
        rows = []
        for k, (name, words) in enumerate(DOMAIN_KEYWORDS.items()):
            n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
            rows.append(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("domain"), F.lit(len(words)).alias("of")))
        return F.array_max(F.array(*rows))

    def best(b: Column) -> Column:
        return F.when(b["n"] == 0, told("general", 0)).otherwise(F.struct(b["domain"].alias("domain"), half_even(b["n"] / b["of"]).alias("confidence")))

    auto = F.when(blank, told("general", 0)).otherwise(once(F.lower(text), lambda low: once(hits(low), best)))
    if mode == "auto" or answer is None:
        return auto
    model = F.struct(model_domain(answer).alias("domain"), F.lit(MODEL_CONFIDENCE).alias("confidence"))
    return F.when(~blank & answer.isNotNull(), model).otherwise(auto)


def both(text: Column, mode: str = "auto", manual: str | None = None) -> Column:
    """struct<domain, language, domain_confidence, language_confidence>."""
    d, l = domain(text, mode, manual), language(text)
    return F.struct(d["domain"].alias("domain"), l["language"].alias("language"), d["confidence"].alias("domain_confidence"), l["confidence"].alias("language_confidence"))


def model_domain(answer: Column) -> Column:
    """Domain in a model's answer: the answer itself, else the first that it contains."""
    low = F.lower(strip(answer))
    out = F.lit("general")
    for d in reversed(MODEL_DOMAINS):
        out = F.when(F.contains(low, F.lit(d)), F.lit(d)).otherwise(out)
    return F.when(low.isin(*MODEL_DOMAINS), low).otherwise(F.coalesce(out, F.lit("general")))


def visual_prompt(script: Column, topic: Column) -> Column:
    """What follows the first "visual_concept:", else a line on the topic."""
    found = F.nullif(strip(F.regexp_extract(script, r"(?i)visual_concept\s*:\s*(.+)", 1)), F.lit(""))
    return F.coalesce(found, F.concat(F.lit("Illustration of "), topic))


def voice(language_code: Column, voice_id: Column, voices: dict[str, dict[str, str]]) -> Column:
    """A voice that its language has is kept; else the language's default."""
    out = F.lit("default")
    for code, known in voices.items():
        chosen = F.when(voice_id.isin(*known), voice_id).otherwise(F.lit(known.get("default", "default")))
        out = F.when(language_code == code, chosen).otherwise(out)
    return out


def valid_model(name: str, known: tuple[str, ...] = ()) -> bool:
    return name in known or bool(re.fullmatch(r"[A-Za-z0-9._/-]+", name or ""))


def dimensions(name: str | None) -> int:
    return DIMENSIONS.get(name or "", DEFAULT_DIMENSIONS)
