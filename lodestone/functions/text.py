"""Text segmentation as column expressions: sentences, packing with overlap, byte splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SENTENCE_END = r"(?U)(?<=[.!?])\s+|(?<=\n)\s*"
SPEECH_END = r"(?U)(?<=[.!?।])\s+|(?<=\n)\s*|(?<=۔)"
MAX_CHUNK, OVERLAP_RATIO, OVERLAP_CHARS, SPEECH_CHARS = 500, 0.15, 75, 300


#: Code points with the White_Space property.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at the ends, of any kind; looks at the ends alone."""
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    """Sentences of a text, stripped, empty ones dropped; null has none."""
    return F.coalesce(F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != ""), F.array().cast("array<string>"))


def overlap_chars(parts: Column, ratio: float = OVERLAP_RATIO, most: int = MAX_CHUNK) -> Column:
    """Overlap from the mean sentence length, at most that share of a chunk; none for none."""
    total = F.aggregate(parts, F.lit(0), lambda a, s: a + F.char_length(s))
    mean = (total / F.size(parts) * ratio).cast("int")
    return F.when(F.size(parts) > 0, F.least(mean, F.lit(int(most * ratio)))).otherwise(F.lit(0))


def _words(sentence: str, most: int) -> str:
    """SQL: a long sentence as word runs of at most ``most`` characters."""
    return f"""aggregate(filter(split({sentence}, '(?U)\\\\s+'), w -> w <> ''),
        named_struct('out', cast(array() as array<string>), 'cur', cast(null as string), 'n', 0),
        (a, w) -> if(a.n + length(w) + 1 > {most} and a.cur is not null,
            named_struct('out', array_append(a.out, a.cur), 'cur', w, 'n', length(w) + 1),
            named_struct('out', a.out, 'cur', if(a.cur is null, w, concat(a.cur, ' ', w)), 'n', a.n + length(w) + 1)),
        a -> if(a.cur is null, a.out, array_append(a.out, a.cur)))"""


def pack(parts: str, most: int = MAX_CHUNK, overlap: int | str = OVERLAP_CHARS, carry: str = "word") -> Column:
    """Chunks of the sentences in array column ``parts``: sentences are joined while they
    fit; a new chunk begins with what the last ``overlap`` characters of the one before (a
    number, or a column's name) hold behind their last space (all of them with
    carry="tail"). A sentence that does not fit alone is split at words and shares nothing
    with its neighbours. Folded in the JVM."""
    tail = f"if({overlap} < length(a.cur), right(a.cur, {overlap}), a.cur)"
    kept = f"element_at(split({tail}, ' '), -1)" if carry == "word" else tail
    carried = f"if({overlap} > 0, concat({kept}, ' ', s), s)"
    carried_n = f"if({overlap} > 0, length({kept}), 0) + length(s) + 1"
    return F.expr(f"""aggregate({parts},
        named_struct('out', cast(array() as array<string>), 'cur', cast(null as string), 'n', 0),
        (a, s) -> case
            when length(s) > {most} then named_struct('out', concat(a.out, if(a.cur is null, cast(array() as array<string>), array(a.cur)), {_words('s', most)}), 'cur', cast(null as string), 'n', 0)
            when a.n + length(s) > {most} and a.cur is not null then named_struct('out', array_append(a.out, a.cur), 'cur', {carried}, 'n', {carried_n})
            else named_struct('out', a.out, 'cur', if(a.cur is null, s, concat(a.cur, ' ', s)), 'n', a.n + length(s) + 1) end,
        a -> if(a.cur is null, a.out, array_append(a.out, a.cur)))""")


def speech_chunks(text: str, most: int = SPEECH_CHARS) -> Column:
    """A text for speech: whole if it fits, else sentences joined while their lengths
    (spaces uncounted) fit; a text without sentences is cut hard."""
    fold = f"""aggregate(sents, named_struct('out', cast(array() as array<string>), 'cur', cast(null as string), 'n', 0),
        (a, s) -> if(a.n + length(s) > {most} and a.cur is not null,
            named_struct('out', array_append(a.out, a.cur), 'cur', s, 'n', length(s)),
            named_struct('out', a.out, 'cur', if(a.cur is null, s, concat(a.cur, ' ', s)), 'n', a.n + length(s))),
        a -> if(a.cur is null, a.out, array_append(a.out, a.cur)))"""
    parts = f"filter(transform(split({text}, r'{SPEECH_END}'), x -> regexp_replace(x, r'(?U)^\\s+|\\s+$', '')), x -> x <> '')"
    hard = f"transform(sequence(0, cast(ceil(length({text}) / {most}) as int) - 1), i -> substring({text}, i * {most} + 1, {most}))"
    folded = fold.replace("sents", parts)
    return F.expr(f"case when length({text}) <= {most} then array({text}) when size({folded}) > 0 then {folded} else {hard} end")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def each(df: DataFrame, keep: list, array: Column, value: str, pos: str = "pos") -> DataFrame:
    """``keep`` of df, and a row for each element of an array with its place. The generator
    is an outer one: for an inner one Catalyst adds a filter on the array's size, and so
    computes the array twice."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def byte_split(text: Column, most: int) -> Column:
    """A text cut every ``most`` UTF-8 bytes, never inside a character; a character wider
    than that is dropped. Null and empty texts have no pieces. Folded in the JVM, a step a
    piece."""
    if most <= 0:
        raise ValueError("most must be positive")

    def cut(raw: Column) -> Column:
        size = F.octet_length(raw)
        byte = lambda i: F.hex(F.substring(raw, i + 1, F.lit(1)))
        inner = lambda i: byte(i).between("80", "BF")

        def step(a: Column, _: Column) -> Column:
            at, stop = a["at"], F.least(a["at"] + most, size)
            end = F.when((stop >= size) | ~inner(stop), stop).when(~inner(stop - 1), stop - 1).when(~inner(stop - 2), stop - 2).otherwise(stop - 3)
            lead = byte(at)
            width = F.when(lead >= "F0", 4).when(lead >= "E0", 3).when(lead >= "C0", 2).otherwise(1)
            piece = F.decode(F.substring(raw, at + 1, end - at), "UTF-8")
            out = F.when(end > at, F.array_append(a["out"], piece)).otherwise(a["out"])
            return F.when(at >= size, a).otherwise(F.struct(out.alias("out"), F.when(end > at, end).otherwise(at + width).alias("at")))

        steps = F.sequence(F.lit(1), F.ceil(size / max(1, most - 3)).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
        return F.when(size > 0, F.aggregate(steps, start, step, lambda a: a["out"]))

    return F.coalesce(once(F.encode(text, "UTF-8"), cut), F.array().cast("array<string>"))


def byte_safe(parts: Column, most: int) -> Column:
    """Sentences, those of more than three bytes a character of a chunk cut at that."""
    cut = F.flatten(F.transform(parts, lambda s: F.when(F.octet_length(s) <= 3 * most, F.array(s)).otherwise(byte_split(s, 3 * most))))
    return F.when(F.exists(parts, lambda s: F.octet_length(s) > 3 * most), cut).otherwise(parts)


def check_chunking(most: int, ratio: float, overlap: int | None) -> None:
    if most <= 0:
        raise ValueError("max_chunk_size must be positive")
    if not 0 <= ratio <= 1:
        raise ValueError("overlap_ratio must be between 0 and 1")
    if overlap is not None and overlap < 0:
        raise ValueError("overlap_chars must not be negative")


def query_tokens(text: Column) -> Column:
    """Lower-cased words of three or more word characters (letters, numbers, underscore)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]{3,})(?![\p{L}\p{N}_])"), F.lit(1))


def segmented(text: Column, tokenizer: Callable[[], Callable[[str], list[str]]]) -> Column:
    """Parts of a text by a tokenizer that ``tokenizer()`` makes once a task."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = tokenizer()
        for texts in batches:
            yield texts.map(lambda t: [p.strip() for p in cut(t) if p.strip()] if t else [])

    return run(text)
