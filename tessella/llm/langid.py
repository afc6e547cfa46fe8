"""Language identification by compression: each language has a zstandard raw-content dictionary, and a text is of the language whose
dictionary makes it smallest. The answer is rejected where the second language comes within `margin` of that size, as a share of it. Of equal
sizes, which are rejected too, the language with the larger share of the labelled rows is named.

Dictionaries hold snippets of the distinct texts of labelled rows, taken in the order of a seeded hash up to `snippets` x `snippet_chars`
characters for each language. About four times as many candidates, those below a bound of the hash, reach the driver: the documented bound on
what is gathered, for each language that has labels. Texts are compressed whole, in blocks small enough that the dictionary and not the text's
own beginning decides; a very long text is one more block after another.

Null text or one without a letter: `und`, score 0, rejected. Without any labelled row everything is `und`. Null labels teach nothing. An
empty table gives no rows. Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import crc_bucket, keeping, map_rows, read, with_kept

SNIPPETS, SNIPPET_CHARS, BLOCK_BYTES, LEVEL = 300, 300, 8192, 5
MARGIN = 0.02
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased runs of letters and of what is beyond ASCII, with one blank between them."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang", seed: int = 11, snippets: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> dict[str, tuple[bytes, float]]:
    """By language: raw dictionary content, from at most `snippets` distinct texts each, cut in their middle to `chars` characters; and the
    language's share of all labelled rows."""
    t, n = F.col(text), F.length(text)
    h = F.xxhash64(F.lit(seed), t)
    labelled = labelled.where(F.col(lang).isNotNull())
    copies = labelled.groupBy(F.col(lang).alias("l"), F.when(n > 0, h).alias("h")).count()
    counts, distinct = {}, {}
    for r in copies.groupBy("l").agg(F.sum("count").alias("rows"), F.count("h").alias("texts")).collect():
        counts[r.l], distinct[r.l] = r.rows, r.texts
    if not counts:
        return {}
    # Hashes below a bound that about four times as many texts of the language pass as are wanted, so that no task gets a whole language.
    bound = F.create_map(*(F.lit(x) for l, c in distinct.items() for x in (l, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * snippets // max(1, c)))))
    cut = labelled.where((n > 0) & (h <= bound[F.col(lang)])).select(
        F.col(lang).alias("l"), h.alias("h"), F.when(n > chars, t.substr(((n - chars) / 2).cast("int") + 1, F.lit(chars))).otherwise(t).alias("s")
    )
    out: dict[str, list[tuple[int, str]]] = {}
    for l, h, s in cut.distinct().collect():
        out.setdefault(l, []).append((h, s))
    return {l: (b" ".join(letters(s) for _, s in sorted(rows)[:snippets]), counts[l] / sum(counts.values())) for l, rows in sorted(out.items())}


class CompressionClassifier:
    def __init__(self, dictionaries: dict[str, tuple[bytes, float]], level: int = LEVEL, block: int = BLOCK_BYTES) -> None:
        import zstandard

        self.block, self.langs, self.compress = block, sorted(dictionaries), []
        self.share = [dictionaries[x][1] for x in self.langs]
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang][0] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compress.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text takes with each language's dictionary."""
        data = letters(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the margin is too narrow. The score is 0.5 at equal sizes and grows with the gap in bytes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], -self.share[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        gap = sizes[order[1]] - sizes[order[0]]
        return self.langs[order[0]], 1 - 0.5 * 2.0**-gap, gap <= margin * sizes[order[0]]


def identify(df: DataFrame, dictionaries: dict[str, tuple[bytes, float]], keep: list[str], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """`keep` columns, then lang_pred, score, rejected."""
    return judged(df, dictionaries, keep, text, margin).select("kept.*", "lang_pred", "score", "rejected")


def judged(df: DataFrame, dictionaries: dict[str, tuple[bytes, float]], keep: list[str], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(kept, lang_pred, score, rejected), the `keep` columns as one struct, whatever their names."""
    held: list[CompressionClassifier] = []

    def work(batches: Iterator[list]):
        held[:] = held or [CompressionClassifier(dictionaries)]
        for cols in batches:
            done = [held[0].predict(t.as_py(), margin) for t in (cols[0].field(text) if inside else cols[1])]
            yield [cols[0], *([d[i] for d in done] for i in range(3))]

    rows, inside = keeping(df, keep, text), text in keep
    return map_rows(rows, rows.columns, work, with_kept(rows, "lang_pred string, score double, rejected boolean"), arrow=True)


def training_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.where(crc_bucket(key, 5) != 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the fixed held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.withColumn("held_out", crc_bucket("doc_id", 5) == 0), fit_dictionaries(training_rows(docs)), ["doc_id", "held_out"])
