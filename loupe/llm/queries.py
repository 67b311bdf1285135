"""The registered queries of this package: thin calls of its operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.mixing import MixParams

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the doc_id's text leaves 1 modulo 3 (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the two marks: 0 low quality, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def domain() -> F.Column:
    """The domain of a document: its source's last digits modulo 3 (a source without digits: other)."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), "([0-9]{1,6})$", 1)
    names = F.array(F.lit("web"), F.lit("books"), F.lit("forum"))
    return F.when(number == "", "other").otherwise(F.get(names, number.try_cast("int") % 3))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Target weights of the mixing query and stage: 90 % of the supplied tokens, at most three epochs of a source.
MIX = MixParams(domains={"web": 0.45, "books": 0.35, "forum": 0.15}, languages={"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1},
                other=0.05, budget_share=0.9, max_epochs=3, seed=17)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learnt from the rows that are not held out."""
    from loupe.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score_toxicity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of a grade of 1 or more; grades are learnt from the rows that are not held out."""
    from loupe.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, ratings(spark, sf_dir).filter(~held_out()))
    return score_quality(docs, model, least=1).select(
        "doc_id", held_out().alias("held_out"), "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document: windows of 50 words that also start in an earlier document."""
    from loupe.llm.substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=50)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    import public_tokenizers

    from loupe.llm.tokencount import count_tokens, zipf_unigram

    return count_tokens(table(spark, sf_dir, "documents"), zipf_unigram(public_tokenizers.path("piece_bpe_32k.model")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) that overlap by spaced seeds and the check around them."""
    from loupe.llm.decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_equal", "n_compared")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the written token files."""
    from loupe.llm.tokenfile import read_token_files, write_token_files

    docs = table(spark, sf_dir, "documents")
    return read_token_files(spark, write_token_files(docs, tokenizer_path()))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and weakly supervised verdict of every document."""
    from loupe.llm.rules import quality_by_rules

    return quality_by_rules(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, at most 2 differing bits)."""
    from loupe.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and epoch that the domain, language and source budgets take."""
    from loupe.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), domain(), MIX)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its repaired role and rendered piece."""
    from loupe.llm.chat import repair_and_render

    return repair_and_render(table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of at least 7 code points that occurs at least twice."""
    from loupe.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), least=7, at_least=2, noise=31, factor=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 5 words of every language, by their lowest-scoring cut."""
    from loupe.llm.collocation import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose vec_id is divisible by 20."""
    from loupe.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20)


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_toxicity, op2_quality, op3_substring_dedup, op4_token_counts, op5_decontamination,
    op6_token_files, op7_quality_rules, op8_simhash, op9_mixing, op10_chat,
    op11_spelling_variants, op12_collocations, op13_neighbours)}

_WINDOWS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _fill_sql(nodes: str, parent: str, node: str) -> str:
    """DuckDB twin of ``mixing.fill`` over the CTE ``nodes`` (weight, lim, budget)."""
    w = f"PARTITION BY {parent}" if parent else ""
    return f"""SELECT * EXCLUDE (full_, rest, open_), CASE WHEN full_ THEN lim ELSE rest * weight / open_ END AS share FROM (
  SELECT *, budget - sum(CASE WHEN full_ THEN lim ELSE 0 END) OVER ({w}) AS rest, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({w}) AS open_ FROM (
    SELECT *, coalesce(sum(lim) OVER ({w} ORDER BY lim / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + lim / weight * sum(weight) OVER ({w} ORDER BY lim / weight, {node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget AS full_
    FROM {nodes} WHERE weight > 0))"""


def _mix_sql() -> str:
    def weight(name: str, weights: dict[str, float]) -> str:
        return "CASE " + name + "".join(f" WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items()) + f" ELSE {MIX.other}::DOUBLE END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, md5(coalesce(text, '')) AS digest, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  CASE WHEN regexp_extract(source, '([0-9]{{1,6}})$', 1) = '' THEN 'other' ELSE (['web', 'books', 'forum'])[regexp_extract(source, '([0-9]{{1,6}})$', 1)::INT % 3 + 1] END AS domain FROM documents),
s AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS supply, sum(n_tokens)::DOUBLE * {MIX.max_epochs} AS lim FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
m AS (SELECT domain, sum(lim) AS lim, {weight("domain", MIX.domains)} AS weight, sum(sum(supply)) OVER () * {MIX.budget_share}::DOUBLE AS budget FROM s GROUP BY domain),
ms AS ({_fill_sql("m", "", "domain")}),
l AS (SELECT domain, lang, sum(s.lim) AS lim, {weight("lang", MIX.languages)} AS weight, any_value(ms.share) AS budget FROM s JOIN ms USING (domain) GROUP BY domain, lang),
ls AS ({_fill_sql("l", "domain", "lang")}),
x AS (SELECT domain, lang, source, supply, s.lim, {MIX.other}::DOUBLE AS weight, ls.share AS budget FROM s JOIN ls USING (domain, lang)),
xs AS (SELECT domain, lang, source, supply, floor(share + 1e-6) AS budget, floor(floor(share + 1e-6) / supply)::BIGINT AS epochs FROM ({_fill_sql("x", "domain, lang", "source")})),
c AS (SELECT *, row_number() OVER (PARTITION BY domain, lang, source, id, digest) - 1 AS copy FROM d),
h AS (SELECT c.*, epochs, budget - epochs * supply AS rest, md5(concat_ws(':', '{MIX.seed}', epochs::VARCHAR, id, digest, copy::VARCHAR)) AS h FROM c JOIN xs USING (domain, lang, source)),
t AS (SELECT *, epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS taken FROM h)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(taken))::INT AS epoch FROM t"""


#: A-Z to a-z; DuckDB's own lower() changes other letters too.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The letters beyond ASCII as single bytes, since DuckDB's levenshtein compares bytes.
_BYTES = "translate(word, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(map(chr, range(33, 97))).replace("'", "''") + "')"

#: crc32 byte by byte over the table of its polynomial; a word's near words share one of its deletions.
_SPELLING_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 7 GROUP BY ALL),
coded AS (SELECT w, c, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b FROM each),
hashed AS (SELECT w, c, xor(list_reduce(list_concat([4294967295], b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM coded, tab),
noised AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, (h % length(w))::BIGINT), substr(w, (h % length(w))::BIGINT + 2)) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n, {_BYTES} AS one FROM noised WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, one, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, 1, i - 1), substr(word, i + 1))), word)) AS d FROM words),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b USING (d) WHERE a.word <> b.word AND levenshtein(a.one, b.one) = 1),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS top FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top[1] >= 10 * n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * n THEN (-top[1])::BIGINT END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS node, 0 AS step FROM forms UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.node WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(node, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""

_PHRASES_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) r(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
parts AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
cuts AS (SELECT p.lang, p.phrase, p.a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * p.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM parts p
  JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.ws[1:k], ' ') JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.ws[k + 1:], ' ') JOIN totals t ON t.lang = p.lang),
low AS (SELECT lang, phrase, a, n, min((score, k, l, r)) AS c FROM cuts GROUP BY ALL),
inner_ AS (SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, a, ws, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT lang, a, ws, m, unnest(range(2, m)) AS s FROM parts WHERE k = 1))),
over_ AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY c[1] DESC, a DESC, phrase) AS rank, phrase, a, c[3] AS l, c[4] AS r, n, c[1] AS score
  FROM low LEFT JOIN over_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT * FROM ranked WHERE rank <= 2000"""


#: DuckDB twins of the queries that SQL can express. The others need a tokenizer, a fitted
#: model, XXH64 or a shortest path and are tested against brute force in ``tests/llm``.
ORACLE: dict[str, str] = {"op3_substring_dedup": _WINDOWS_SQL, "op9_mixing": _mix_sql(),
                          "op11_spelling_variants": _SPELLING_SQL, "op12_collocations": _PHRASES_SQL}


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
