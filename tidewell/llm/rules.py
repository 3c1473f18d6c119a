"""Operator 6: a table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
SYMBOLS = "[#*$%&|<>]+"
CAPITALS = "[A-ZÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÙÚÛÜ]+"
WORD = "[^\\x20\\x09-\\x0D]"
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "be", "by", "this", "from", "at",
    # French
    "le", "la", "les", "des", "et", "un", "une", "du", "est", "dans", "que", "pour", "par", "sur", "pas", "avec",
    # German
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "für", "nicht", "ein", "eine", "auf", "im",
    # Spanish and others
    "el", "los", "las", "del", "se", "con", "por", "una", "su", "al", "no", "de", "en", "es", "o", "y", "a",
)


@dataclass(frozen=True)
class Rule:
    """``metric`` in per cent of ``per`` (or as it is) must lie between ``least`` and ``most``."""

    name: str
    metric: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def fails(self) -> Column:
        value, unit = (F.col(self.metric) * 100, F.col(self.per)) if self.per else (F.col(self.metric), F.lit(1))
        low = value < self.least * unit if self.least is not None else F.lit(False)
        return low | (value > self.most * unit) if self.most is not None else low


RULES = (
    Rule("few words", "n_words", least=50),
    Rule("word length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("capitals", "n_capitals", "word_chars", most=30),
    Rule("stop words", "n_stop_words", "n_words", least=2),
    Rule("repeated words", "n_repeat_words", "n_words", most=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=80),
    Rule("bullet lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut lines", "n_cut_lines", "n_lines", most=30),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def length_of(text: Column, signs: str) -> Column:
    """Characters of ``text`` in runs of ``signs``."""
    return F.length(text) - F.length(F.regexp_replace(text, signs, ""))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that a text holds twice or more; windows are compared by a 64-bit hash.

    Windows are sorted with their positions, so that equal ones stand side by side.
    """

    def covered(hashes: Column) -> Column:
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(rows: Column) -> Column:
            same = F.transform(rows, lambda r, j: F.when(
                (r["h"] == F.get(rows, j - 1)["h"]) | (r["h"] == F.get(rows, j + 1)["h"]), r["i"]))
            return let(F.array_compact(same), lambda at: F.size(F.array_distinct(F.flatten(F.array(
                at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(paired, marked))

    hashes = F.transform(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda third, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), third))
    return let(hashes, covered)


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns and the counts that rules speak of; Spark expressions only. Null texts count as empty."""
    t, words, lines = F.col("_t"), F.col("_words"), F.col("_lines")
    held = docs.select(*[F.col(c) for c in keep or []], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    cut = held.select(*[F.col(c) for c in keep or []], "_t", F.filter(F.split(t, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "").alias("_words"),
                      F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    stop = [w for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize()))]
    return cut.select(
        *[F.col(c) for c in keep or []], F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        length_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        let(words, repeat_words).cast("long").alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
        length_of(t, CAPITALS).cast("long").alias("n_capitals"),
        F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("• "))).cast(
            "long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_cut_lines"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``failed`` (names of the rules that failed), a row for each row.

    Null and empty texts have no words and fail. Null ids stay null; repeated rows are judged each.
    """
    m = measures(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", ["_id"])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    out = m.select("*", base.alias("base_failed"), failed.alias("failed"))
    return out.select(F.col("_id").alias(doc_id), *m.columns[1:], "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


#: The columns of the registered query, as SQL for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(l) AS n_lines, length(regexp_replace(t, '[^A-ZÀÁÂÄÆÇÈÉÊËÍÎÏÑÓÔÖŒÙÚÛÜ]+', '', 'g')) AS n_capitals,
        len(list_filter(w, lambda x: x IN (
          'the','of','and','to','in','is','that','for','it','with','as','was','on','are','be','by','this','from','at',
          'The','Of','And','To','In','Is','That','For','It','With','As','Was','On','Are','Be','By','This','From','At',
          'le','la','les','des','et','un','une','du','est','dans','que','pour','par','sur','pas','avec',
          'Le','La','Les','Des','Et','Un','Une','Du','Est','Dans','Que','Pour','Par','Sur','Pas','Avec',
          'der','die','das','und','den','von','zu','mit','ist','für','nicht','ein','eine','auf','im',
          'Der','Die','Das','Und','Den','Von','Zu','Mit','Ist','Für','Nicht','Ein','Eine','Auf','Im',
          'el','los','las','del','se','con','por','una','su','al','no','de','en','es','o','y','a',
          'El','Los','Las','Del','Se','Con','Por','Una','Su','Al','No','De','En','Es','O','Y','A'))) AS n_stop,
        len(list_filter(l, lambda x: regexp_matches(x, '^ *(- |\* |• )'))) AS n_bullet,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_cut FROM w),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM r, (VALUES (0), (1), (2)) AS s(d) GROUP BY doc_id),
q AS (SELECT m.*, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars * 100 BETWEEN 200 * n_words AND 1500 * n_words AND n_symbols * 100 <= 10 * n_words
    AND n_capitals * 100 <= 30 * word_chars AND n_stop * 100 >= 2 * n_words AND n_dup_lines * 100 <= 80 * n_lines
    AND n_bullet * 100 <= 90 * n_lines AND n_cut * 100 <= 30 * n_lines AS kept
FROM b
"""
