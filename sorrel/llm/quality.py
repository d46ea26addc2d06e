"""Per-document text statistics, exact per-language ranks, outlier scores, and the form of texts that are no prose.

1. ``document_stats``: counts and shares per document (Arrow batches, no shuffle). The language is the one whose common
   words (a fixed table) the text uses most, because the stored code may be wrong or missing.
2. ``tail_probabilities``: equal values are counted first, the distinct values are range-partitioned and sorted, and
   partition offsets turn positions inside partitions into exact ranks; no partition holds a whole language.
3. ``outliers``: -ln of the empirical tail probability, summed over the statistics. Each population is joined by ``PLAIN``
   documents of least values, so that a language of few documents has tails too. Texts in no known language are ranked
   among all documents.
4. ``forms``: a text is no prose when its outlier score and the share of its best form together reach ``LIMIT``; neither
   does so alone. The line structure then names the form.

Null, empty and blank texts have null form and no score. Repeated texts are counted each. Ties share a rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut, spread

STATS = ("list_share", "table_share", "junk_share", "symbol_ratio", "digit_ratio", "repeat_share", "rare_words", "open_lines")
# a score of FULL counts as one, and so does a text that is all of one form; more score than that says nothing more
FULL, LIMIT = 6.0, 1.47
PLAIN = 400
UNKNOWN, EVERY = "und", "*"
HOT_SHARE = 1000  # a value is common when it is a thousandth of its population: at most so many for each statistic
MAX_COMMON_WORDS = 100_000

LONG_ITEM = 7  # words of a list item beyond which it reads as prose

END = ".!?。！？…:;\"”»)'’"
BULLET = re.compile(r"\s*(?:[-*+•–—▪◦·‣>]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\[[ xX]?\])\s+\S")
ENTRY = re.compile(r"\s*(?:[\w$][\w$./-]*(?: [\w$./-]+){0,3}\s?(?::|=|=>|->| – | - )\s?\S.{0,60})$")
NAME = re.compile(r"[\w$][\w$./:#()-]*[./_:#-][\w$()]+[,;]?$")
LINK = re.compile(r"\s*(?:[-*+]\s+)?\[[^\]]+\]\([^)]*\)\s*$")
HEAD = re.compile(r"\s{0,3}#{1,6}\s|\s*={1,6}[^=]+={1,6}\s*$")
RULE = re.compile(r"\s*[-=_+|:*~ ]{3,}$")
HTML_ROW = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b", re.I)
WIKI_ROW = re.compile(r"\s*(?:\{\||\|-|\|\}|!\s?\S.*!!|\|\s?\S.*\|\|)")
TEX_ROW = re.compile(r"[^&]*&.*\\\\\s*(?:\\hline)?$|\s*\\(?:hline|begin\{tabular\}|end\{tabular\}|toprule|midrule|bottomrule)")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
TIGHT = re.compile(r"[,;](?=\S|$)")
HEX = re.compile(r"\s*(?:[0-9a-fA-F]{4,8}[: ]\s*)?(?:[0-9a-fA-F]{2,8}\s+){4,}")
BLOB = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
MOJIBAKE = re.compile(r"[ÃÂâåçéäèæïðãê][\x80-\xbfŒ-Ÿˆ˜–-›€™]|�")
WORD = re.compile(r"[^\W\d_]+")
CJK = re.compile(r"[一-鿿]")
ODD = re.compile(r"[←-⯿\U0001f000-\U0001faff�\x00-\x08\x0e-\x1f\x7f-\x9f-]")
MARKS = re.compile(r"[|\t<&\\/+=_]|  |[,;]\S|^\w{1,5}[.)]\s|^\(")
MARKER = re.compile(r"\s*([-*+•–—▪◦·‣>|#%;]|//)\s")
INNER_END = re.compile(r"[^\W\d]{2}[.!?;] +\w")
NO_DIGITS = str.maketrans("", "", "0123456789")
NO_PUNCT = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")
LATIN1 = re.compile(r"[\x80-\xff]")
PUNCT = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"\d")
SIGNS = re.compile(r"[^\w\s]{4,}")
RUN = re.compile(r"([^\w\s])\1{3,}")
VOWEL = re.compile(r"[aeiouyäöüáéíóúàèâêîôûåæøœ]", re.I)
NAV_SEP = re.compile(r"\s*(?:\||>|»|·|/|•|::)\s*|\s{2,}")


def line_forms(text: str) -> tuple[float, float, float, float, int]:
    """Shares of the non-blank characters in lines of lists, of tables, of encoded data; repeated lines; open lines."""
    lines = [x for x in re.split(r"\r\n|[\n\r \x85]", text) if x.strip()]
    total = sum(map(len, lines)) or 1
    kinds, fenced = [], False
    for x in lines:
        s = x.strip()
        n = len(s)
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            kinds.append("code")
        elif fenced:
            kinds.append("code")
        elif s[-1] in ".!?" and s[0].isupper() and not MARKS.search(x):
            kinds.append("prose")
        elif HEX.match(s) and not re.search(r"[g-zG-Z]{3}", s[:40]):
            kinds.append("hex")
        elif BLOB.search(s) and sum(map(len, BLOB.findall(s))) > 0.7 * n and "_" not in s and "." not in s and re.search(r"[a-z]", s) and re.search(r"[A-Z0-9]", s):
            kinds.append("hex")
        elif HTML_ROW.search(s) or WIKI_ROW.match(s) or TEX_ROW.match(s):
            kinds.append("table")
        elif s.count("|") >= 2:
            kinds.append("table")
        elif "\t" in s and not (s[-1] in ".!?。" and s.count(" ") > 8):
            kinds.append("table")
        elif RULE.match(s) and n > 2:
            kinds.append("rule")
        elif LINK.match(s):
            kinds.append("list")
        elif BULLET.match(x):
            # sentences behind a prefix on every line are wrapped prose
            kinds.append("prose" if s.count(" ") > LONG_ITEM else "list")
        elif HEAD.match(x):
            kinds.append("head")
        elif not CJK.search(s) and len(TIGHT.findall(s)) >= 2 and len(TIGHT.findall(s)) > 2 * (s.count(", ") + s.count("; ")) :
            kinds.append("table")
        elif NAME.match(s) or (ENTRY.match(s) and s[-1] not in ".!?。"):
            kinds.append("list")
        elif GAPS.search(s) and not (s[-1] in END and s.count(" ") > 8) and (s[-1] not in END or len(GAPS.findall(s)) >= 2) and (s.count("  ") < 7 or not re.search(r"[a-z],  ", s)):
            kinds.append("table")
        elif n <= 48 and s[-1] not in END + "," and s.count(" ") <= 5 and not CJK.search(s):
            kinds.append("short")
        else:
            kinds.append("prose")
    _unwrap(lines, kinds)
    size = Counter()
    k, m = 0, len(lines)
    while k < m:
        kind = kinds[k]
        if kind == "short":
            e = k
            while e < m and kinds[e] in ("short", "list"):
                e += 1
            # a run of short open lines is a list; one or two are headings or the end of wrapped prose
            run = [i for i in range(k, e) if kinds[i] == "short"]
            wrapped = k > 0 and kinds[k - 1] == "prose" and len(run) <= 2
            for i in range(k, e):
                size["list" if (len(run) >= 3 and not wrapped) or kinds[i] == "list" else "prose" if wrapped else "head"] += len(lines[i])
            k = e
            continue
        size[kind] += len(lines[k])
        k += 1
    size["table"] += size["rule"] if size["table"] else 0
    # sentences that are one long list of names
    for x, kind in zip(lines, kinds):
        if kind == "prose" and x.count(", ") >= 6:
            parts = re.split(r"[,;]\s+", x.strip().rstrip("."))
            if sum(p.count(" ") <= 0 for p in parts) > 0.8 * len(parts) and sum(map(len, parts)) < 30 * len(parts):
                size["prose"] -= len(x)
                size["list"] += len(x)
    body = max(1, total - size["head"] - (0 if size["table"] else size["rule"]))
    counts = Counter(x.strip() for x in lines)
    repeated = sum(c * len(x) for x, c in counts.items() if c > 2) / total
    ended = sum(x.rstrip()[-1] in END for x in lines)
    return size["list"] / body, size["table"] / body, size["hex"] / total, repeated, ended / len(lines)


def _unwrap(lines: list[str], kinds: list[str]) -> None:
    """Sentences that run on over lines, be it behind one mark on each (quotations, comments), are prose, not items."""
    marks = [m.group(1) if (m := MARKER.match(x)) else "" for x in lines]
    k, m = 0, len(lines)
    while k < m:
        e = k + 1
        while e < m and marks[e] == marks[k] and (marks[k] or kinds[e] in ("short", "prose")):
            e += 1
        if e - k >= 3 and any(kinds[i] in ("list", "short") for i in range(k, e)):
            run = [x.strip() for x in lines[k:e]]
            open_ = 2 * sum(x[-1] in ".!?" for x in run) <= len(run)
            inner = sum(bool(INNER_END.search(x)) for x in run)  # items end with their line
            if open_ and (inner >= 2 and 8 * inner >= len(run) if marks[k] else inner) or _filled(run, marks[k]):
                for i in range(k, e):
                    if kinds[i] in ("list", "short"):
                        kinds[i] = "prose"
        k = e


def _filled(run: list[str], mark: str) -> bool:
    """Whether lines end where the next word would not fit any more."""
    rest = [x[len(mark) :].split() for x in run]
    if len(run) < 4 or sum(map(len, rest)) < 4.5 * len(run) or not all(rest):
        return False
    width = max(map(len, run))
    fits = sum(len(a) + 1 + len(b[0]) <= width for a, b in zip(run, rest[1:]))
    return 10 * fits <= len(run)


def repetition(words: list[str]) -> float:
    """Share of word trigrams that are copies of an earlier one."""
    if len(words) < 12:
        return 0.0
    grams = list(zip(words, words[1:], words[2:]))
    return 1 - len(set(grams)) / len(grams)


class Stats:
    def __init__(self, common: dict[str, set[str]]):
        self.common = {k: v for k, v in common.items() if not any(CJK.match(w) for w in v)}
        zh = sorted({w for v in common.values() for w in v if CJK.match(w)}, key=len, reverse=True)
        self.zh = re.compile("|".join(map(re.escape, zh))) if zh else None
        self.zh_name = next((k for k, v in common.items() if any(CJK.match(w) for w in v)), "zh")

    def of(self, text: str | None) -> dict | None:
        if not text or not text.strip():
            return None
        words = WORD.findall(text.lower())
        n_chars = len(text)
        solid = len(text) - text.count(" ") - text.count("\n") or 1
        plain = text.isascii()
        cjk = 0 if plain else len(CJK.findall(text))
        n_words = len(words)
        counts = Counter(words)
        best, share = "und", 0.0
        for lang, known in self.common.items():
            c = sum(map(counts.__getitem__, known & counts.keys())) / (n_words or 1)
            if c > share:
                best, share = lang, c
        if cjk > 0.2 * solid and self.zh is not None:
            best, share = self.zh_name, min(1.0, 2.5 * sum(map(len, self.zh.findall(text))) / cjk)
        lists, tables, coded, repeated, ended = line_forms(text)
        tokens = text.lower().split()
        symbols = (n_chars - len(text.translate(NO_PUNCT)) if plain else len(PUNCT.findall(text))) / solid
        digits = (n_chars - len(text.translate(NO_DIGITS)) if plain else len(DIGIT.findall(text))) / solid
        odd = len(ODD.findall(text)) / solid
        moji = 0 if plain else len(MOJIBAKE.findall(text))
        latin1 = 0.0 if plain else len(LATIN1.findall(text)) / solid
        runs = sum(len(r.group(0)) for m in SIGNS.findall(text) for r in RUN.finditer(m)) / solid
        # counted letter by letter only where tokens of one character are many enough
        single = sum(len(t) == 1 and t.isalpha() and not CJK.match(t) for t in tokens) / len(tokens) if tables < 0.5 and list(map(len, tokens)).count(1) > 0.6 * len(tokens) else 0.0
        again = repetition(tokens) if cjk <= 0.2 * solid else repetition(re.split(r"[,。,；;!?\s]+", text))
        bare = [w for w in counts if len(w) > 3] if share < 0.12 else []
        # letters that form no words: few vowels, or runs of consonants
        odd_words = sum(1 for w in bare if w.isascii() and (not VOWEL.search(w) or re.search(r"[bcdfghjklmnpqrstvwxz]{5,}|(.)\1\1", w) or len(VOWEL.findall(w)) < 0.2 * len(w))) / (len(bare) or 1)
        junk = max(
            coded, 1.5 * odd, min(1.0, 6.0 * moji / (n_words + 1)) if moji > 2 else 0.0, 2.5 * max(0.0, latin1 - 0.12), 2 * runs,
            1.0 if single > 0.6 and len(tokens) > 8 else 0.0,
            0.9 if digits > 0.6 and tables < 0.3 and lists < 0.5 else 0.0,
            min(1.0, 2.5 * odd_words) if n_words > 5 and odd_words > 0.12 and share < 0.12 else 0.0,
            min(1.0, 1.1 * again) if again > 0.7 and (n_words > 20 or cjk > 20) else 0.0,
            1.0 if repeated > 0.6 and len(tokens) > 8 else 0.0,
            0.8 if share < 0.08 and lists < 0.45 and tables < 0.45 and n_words >= 8 and cjk <= 0.2 * solid and (share == 0 or n_words >= 30 or ended < 0.5) else 0.0,
            0.8 if best == self.zh_name and cjk > 20 and share < 0.1 and lists < 0.45 and tables < 0.45 else 0.0,
            0.7 if n_words < 3 and cjk < 3 and solid > 12 else 0.0,
        )
        return {
            "lang_found": best, "n_words": n_words, "mean_word_length": sum(map(len, words)) / (n_words or 1), "symbol_ratio": symbols,
            "ended_lines": ended, "common_share": share, "list_share": lists, "table_share": tables, "junk_share": min(1.0, junk),
            "digit_ratio": digits, "repeat_share": max(again, repeated), "rare_words": max(0.0, 1 - share), "open_lines": 1 - ended,
        }


SCHEMA = "doc_id long, lang_found string, n_words long, mean_word_length double, symbol_ratio double, ended_lines double, common_share double, list_share double, table_share double, junk_share double, digit_ratio double, repeat_share double, rare_words double, open_lines double"


def document_stats(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document; all statistics null for null, empty and blank texts. ``common_words`` is a fixed table (size checked)."""
    rows = common_words.where("word is not null and lang is not null").limit(MAX_COMMON_WORDS + 1).collect()
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError("too many common words")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r.lang, set()).add(r.word)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stats = Stats(common)
        kinds = {"lang_found": pa.string(), "n_words": pa.int64()}
        for batch in batches:
            found = [stats.of(t.as_py()) or {} for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array([f.get(n) for f in found], kinds.get(n, pa.float64())) for n in names[1:])], names=names)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def tail_probabilities(values: DataFrame, parts: int) -> DataFrame:
    """Of (lang, stat, value) rows: lang, stat, value, n, all, tail = share of the population, plain documents included, with that value or more. Exact."""
    counts = values.groupBy("lang", "stat", "value").agg(F.count("*").alias("n"))
    # the population of texts in no known language is the whole corpus
    pooled = counts.groupBy("stat", "value").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("lang"), "stat", "value", "n")
    placed = cut(counts.unionByName(pooled).repartitionByRange(parts, "lang", "stat", "value").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("lang", "stat", "part").agg(F.sum("n").alias("s"))
    # one row for each partition that holds a piece of a language's statistic: bounded by parts, not by documents
    by = W.partitionBy("lang", "stat")
    offsets = sums.select("lang", "stat", "part", (F.sum("s").over(by.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(by).alias("all"))
    inside = W.partitionBy("lang", "stat", "part").orderBy("value")
    ranked = placed.withColumn("upto", F.sum("n").over(inside) - F.col("n"))
    plain = F.when(F.col("value") > 0, 0).otherwise(PLAIN)
    tail = (F.col("all") - F.col("before") - F.col("upto") + plain) / (F.col("all") + PLAIN)
    return ranked.join(offsets, ["lang", "stat", "part"]).select("lang", "stat", "value", "n", "all", tail.alias("tail"))


def outliers(stats: DataFrame, parts: int | None = None) -> DataFrame:
    """``stats`` with ``outlier``: the sum of -ln(tail) over the statistics. A value of zero, the least, adds nothing."""
    parts = parts or max(8, stats.sparkSession.sparkContext.defaultParallelism)
    long = stats.where("n_words is not null").select(
        "doc_id", F.col("lang_found").alias("lang"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in STATS])).alias("s"),
    ).select("doc_id", "lang", "s.stat", "s.value")
    # zeros take part in the ranks
    tails = cut(tail_probabilities(long.select("lang", "stat", "value"), parts))
    mine = long.where("value > 0").withColumn("lang", F.when(F.col("lang") == UNKNOWN, EVERY).otherwise(F.col("lang")))
    # a common value may stand in a third of all documents: the few common ones are broadcast, the rest are joined by a shuffle
    hot = tails.where(F.col("n") * HOT_SHARE >= F.col("all")).select("lang", "stat", "value", F.col("tail").alias("hot"))
    rest = tails.where(F.col("n") * HOT_SHARE < F.col("all")).select("lang", "stat", "value", "tail")
    met = mine.join(F.broadcast(hot), ["lang", "stat", "value"], "left")
    score = met.where("hot is not null").select("doc_id", F.col("hot").alias("tail")).unionAll(met.where("hot is null").join(rest, ["lang", "stat", "value"]).select("doc_id", "tail"))
    scored = score.groupBy("doc_id").agg(F.sum(-F.log("tail")).alias("outlier"))
    return stats.join(scored, "doc_id", "left").withColumn("outlier", F.round(F.when(F.col("n_words").isNotNull(), F.coalesce("outlier", F.lit(0.0))), 6))


def forms(scored: DataFrame) -> DataFrame:
    """``scored`` with ``form``: list, table, junk, prose, or null for blank texts."""
    lists, tables, junk = F.col("list_share"), F.col("table_share"), F.col("junk_share")
    structured = lists + tables
    evidence = F.least(F.lit(1.0), F.greatest(structured, junk)) + F.least(F.col("outlier") / FULL, F.lit(1.0))
    form = (
        F.when(F.col("n_words").isNull(), F.lit(None).cast("string")).when(evidence < LIMIT, "prose")
        .when(junk >= F.greatest(lists, tables) - 0.05, "junk").when(tables >= lists, "table").otherwise("list")
    )
    return scored.withColumn("form", form)


def quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    return forms(outliers(cut(document_stats(documents, common_words))))
