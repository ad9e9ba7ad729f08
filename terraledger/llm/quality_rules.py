"""Line-first cleaning: every line is judged alone, failures go, and a document that loses too much text goes too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import text_or_empty
from .textstats import SPACE, repeated_words, spaces, symbols, word_hashes, worded_lines

# Fixed values of the rules.
#: Marks that punctuate prose, in the scripts that have their own.
MARKS = frozenset(".,;:!?…。，、；：！？।؟،؛\"'”’»)")
SEPARATORS = ("|", "»", "›", "•", "·", ">")
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
    "use of cookies",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeated_pct: int = 20
    #: Symbols, separators and double marks that a line may have for each word.
    max_symbols: float = 0.3
    max_separators: float = 0.25
    max_shouts: float = 0.3
    #: Words from which a line needs a mark at all, and those up to which a boilerplate phrase condemns it.
    unmarked_words: int = 20
    boilerplate_words: int = 30
    #: Times that a line may occur.
    max_line_copies: int = 3
    #: Share of word characters that the lines may lose.
    max_lost: float = 0.5


def line_fails(line: str, rules: Rules) -> str | None:
    """The rule that a line with words breaks: punctuation, navigation or boilerplate."""
    n = len(line.encode().split())
    if symbols(line) > rules.max_symbols * n and n >= 3 and line.count("|") + line.count(">") < symbols(line):
        return "punctuation"
    if n >= 3 and line.count("!!") + line.count("??") > rules.max_shouts * n:
        return "punctuation"
    if n >= rules.unmarked_words and not MARKS.intersection(line):
        return "punctuation"
    bars = sum(line.count(c) for c in SEPARATORS)
    if bars >= 3 and bars > rules.max_separators * n:
        return "navigation"
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(x in low for x in BOILERPLATE):
            return "boilerplate"
    return None


def cleaned(text: str, rules: Rules) -> tuple[str, int]:
    """The text without failing lines, and the word characters lost."""
    keep, lost, seen, changed = [], 0, {}, False
    for line in text.split("\n"):
        if line.strip(SPACE):
            seen[line] = times = seen.get(line, 0) + 1
            if times > rules.max_line_copies or line_fails(line, rules):
                lost += len(line) - spaces(line)
                changed = True
                continue
        keep.append(line)
    return ("\n".join(keep) if changed else text), lost


def judged(text: str, rules: Rules) -> dict:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = worded_lines(text)
    n, chars = len(words), len(text) - spaces(text)
    repeat = repeated_words(word_hashes(words))
    failed = n < rules.min_words or 100 * repeat > rules.max_repeated_pct * n
    clean, lost = cleaned(text, rules)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols(text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat,
        "base_failed": failed, "kept": not failed and lost <= rules.max_lost * chars, "chars_lost": lost, "clean_text": clean,
    }


_TYPES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "chars_lost": "long", "clean_text": "string"}


def _mapped(rows: DataFrame, carried: int, outputs: list[str], rules: Rules) -> DataFrame:
    """rows' first columns with outputs of judged() on the last column."""
    schema = T.StructType(list(rows.schema.fields[:carried]))
    for c in outputs:
        schema = schema.add(c, {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}[_TYPES[c]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [judged(t, rules) for t in part.column(carried).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:carried], *[pa.array([g[c] for g in got], kinds[_TYPES[c]]) for c in outputs]], schema.names)

    return rows.mapInArrow(run, schema)


def evaluate(docs: DataFrame, rules: Rules = Rules(), text_output: bool = False) -> DataFrame:
    """One row per row: doc_id, the base counts, base_failed, kept, chars_lost (and clean_text).

    A null text counts as empty and is rejected for want of words; equal or null ids are separate
    rows; an empty table gives none; extra columns are not carried.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return _mapped(rows, 1, [c for c in _TYPES if text_output or c != "clean_text"], rules)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with all their columns; text has lost its failing lines, n_chars (where present) follows it."""
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols if c != "text"])
    got = _mapped(docs.select(row.alias("row"), text_or_empty().alias("text")), 1, ["kept", "chars_lost", "clean_text"], rules).filter("kept")
    out = []
    for c in cols:
        if c == "text":
            out.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("chars_lost") > 0, F.length("clean_text").cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return got.select(*out)


def digest(docs: DataFrame) -> DataFrame:
    return evaluate(docs).drop("chars_lost")
