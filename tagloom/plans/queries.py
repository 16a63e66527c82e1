"""Registered queries of the sequence engine over the given tables, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.storage import materialize, shared_dir
from tagloom.functions.text import joined_by_tags
from tagloom.operators import dictionary as D
from tagloom.operators import metrics
from tagloom.operators import templates as Tpl
from tagloom.operators.inference import certainties, counted, encode, losses, summed_potentials, tagged
from tagloom.operators.segmentation import with_spans, words
from tagloom.operators.training import Params, empirical, lbfgs, objective_of, pseudo_gradient
from tagloom.plans.crf import CrfEstimator
from tagloom.sources import sequences as S

TEMPLATES = [Tpl.parse(t) for t in Tpl.DEFAULT_TEMPLATES]
#: Templates with absolute rows and far offsets, and with patterns and lower-casing.
FAR = [Tpl.parse(t) for t in ("u0:%x[@1,0]", "u1:%x[@-1,0]", "u2:%x[@0,0]", "u3:%x[-6,0]", "u4:%x[5,0]", "u5:%x[-4,0]/%x[4,0]", "*6:%x[@2,0]")]
PATTERNS = [Tpl.parse(t) for t in ('u0:%t[0,0,"^\\\\u$"]', 'u1:%m[0,0,"\\\\d"]', "u2:%X[0,0]", 'u3:%T[-1,0,"x"]', 'u4:%m[1,0,"\\\\a*"]', 'u5:%t[0,0,"\\\\w"]')]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines_of(S.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_segmented(_lines(spark, sf_dir), "sent_id", "line")


def q01_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.transform("cols", lambda r: F.get(r, F.lit(0)))
    return _sequences(spark, sf_dir).select("sent_id", F.size("cols").cast("long").alias("n"), F.array_join(chars, "|").alias("chars"))


def q02_bmes_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("sent_id", F.array_join("labels", "").alias("tags"))


def q03_text_from_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.transform("cols", lambda r: F.get(r, F.lit(0)))
    return _sequences(spark, sf_dir).select("sent_id", joined_by_tags(chars, F.col("labels")).alias("text"))


def _by_template(sequences: DataFrame, templates: list[Tpl.Template]) -> DataFrame:
    rows = Tpl.distinct(sequences, templates)
    per = rows.groupBy("k", "obs").agg(F.sum("n").alias("n"))
    return per.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.char_length("obs")).alias("n_chars"))


def q04_default_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_template(_sequences(spark, sf_dir), TEMPLATES)


def q05_absolute_and_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_template(_sequences(spark, sf_dir), FAR)


def q06_patterns_and_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tpl.distinct(_sequences(spark, sf_dir), PATTERNS).groupBy("k", "obs").agg(F.sum("n").alias("n"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.observations_in(_sequences(spark, sf_dir), TEMPLATES)


def q07_observation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)


def q08_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.labels(_sequences(spark, sf_dir))


def q09_feature_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = q08_label_ids(spark, sf_dir).count()
    rows = D.layout(_dictionary(spark, sf_dir), n)
    return rows.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("uoff", "boff")})


def _prepared(spark: SparkSession, sf_dir: str):
    """A model with zero weights of all lines, its encoded sequences, and its arrays."""
    model, encoded = CrfEstimator().prepare(_sequences(spark, sf_dir))
    return model, encoded, model.arrays()


def _cells(model, values, name: str) -> DataFrame:
    return model.by_cell(values, name).withColumn("previous", F.coalesce("previous", F.lit("")))


def q10_empirical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold counts of all weights, those of label pairs included."""
    model, encoded, arrays = _prepared(spark, sf_dir)
    return _cells(model, empirical(encoded, arrays), "n").where("n <> 0").select("obs", "previous", "label", F.col("n").cast("long").alias("n"))


def q11_label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of (observation, previous label, label), of the templates that read label pairs."""
    seqs = Tpl.features(_sequences(spark, sf_dir), [t for t in TEMPLATES if t.kind != "u"])
    rows = seqs.select(F.posexplode_outer(F.arrays_zip("obs", "labels")).alias("t", "z"), F.col("labels").alias("ls")).where("t > 0")
    rows = rows.select(F.explode_outer("z.obs").alias("obs"), F.get("ls", F.col("t") - 1).alias("previous"), F.col("z.labels").alias("label"))
    return rows.groupBy("obs", "previous", "label").agg(F.count("*").alias("n"))


def q12_objective_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss with all weights at zero, by the distributed forward pass."""
    model, encoded = CrfEstimator().prepare(_sequences(spark, sf_dir))
    return losses(encoded, model.arrays()).agg(F.count("*").alias("n_sent"), F.round(F.sum("loss"), 2).alias("loss"))


def q13_gradient_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of all weights at zero, by the distributed backward pass: expected less gold counts."""
    model, encoded, arrays = _prepared(spark, sf_dir)
    _, g = objective_of(encoded, arrays, Params(), decoded=False)(arrays.theta)
    return _cells(model, g, "g").select("obs", "previous", "label", F.round("g", 6).alias("g"))


def q14_pseudo_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, encoded, arrays = _prepared(spark, sf_dir)
    p = Params()
    _, g = objective_of(encoded, arrays, p, decoded=False)(arrays.theta)
    return _cells(model, pseudo_gradient(arrays.theta, g, p.l1), "pg").select("obs", "previous", "label", F.round("pg", 6).alias("pg"))


def q15_first_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First point that the optimiser's line search tries."""
    model, encoded, arrays = _prepared(spark, sf_dir)
    p, tried = Params(max_iter=1, max_line_search=1), []
    objective = objective_of(encoded, arrays, p, decoded=False)

    def seen(x):
        tried.append(x)
        return objective(x)

    lbfgs(seen, arrays.theta, p, lambda k, f, x: True)
    return _cells(model, tried[-1], "x").where("x <> 0").select("obs", "previous", "label", F.round("x", 7).alias("x"))


def _weighted(spark: SparkSession, sf_dir: str, of_label: Column | None = None):
    """A model of all lines under weights that are multiples of 1/8 made from observations and labels, and its encoded sequences."""
    model, encoded, _ = _prepared(spark, sf_dir)
    own = (F.char_length("obs") % 7 - (F.octet_length("obs") % 5) * (F.ascii("label") % 3 if of_label is None else of_label)) / 8.0
    pair = (F.ascii("previous") * 3 + F.ascii("label")) % 11 / 8.0
    model.weights = model.cells().select("f", F.when(F.col("previous").isNull(), own).otherwise(pair).alias("w"))
    return model, encoded


def q16_unigram_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed potentials by sequence and label, with weights that are multiples of 1/8 made from the observations, and an eighth of the label's own."""
    model, encoded = _weighted(spark, sf_dir, F.char_length("label"))
    arrays = model.arrays()
    parts = [F.struct(F.lit(x).alias("label"), (F.col("u")[k] + ord(x[0]) % 3 / 8.0).alias("score")) for k, x in enumerate(arrays.labels)]
    return summed_potentials(encoded, arrays).select("sent_id", F.explode(F.array(*parts)).alias("c")).select("sent_id", "c.label", "c.score")


def q31_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed potentials by sequence and label, under weights that are multiples of 1/8 made from observations and labels: score of the label's own, into of the pairs that end in it."""
    model, encoded = _weighted(spark, sf_dir)
    arrays = model.arrays()
    parts = [F.struct(F.lit(x).alias("label"), F.col("u")[k].alias("score"), F.col("into")[k].alias("into")) for k, x in enumerate(arrays.labels)]
    return summed_potentials(encoded, arrays).select("sent_id", F.explode(F.array(*parts)).alias("c")).select("sent_id", "c.label", "c.score", "c.into")


def _by_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a baseline's labels: each character's most frequent tag (the first in order of ties)."""
    seqs = materialize(_sequences(spark, sf_dir), "sequences")
    cells = seqs.select("sent_id", F.posexplode(F.arrays_zip(F.transform("cols", lambda r: F.get(r, F.lit(0))).alias("c"), "labels")).alias("t", "z"))
    counts = cells.groupBy(F.col("z.c").alias("c"), F.col("z.labels").alias("label")).agg(F.count("*").alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b")).select("c", "b.label")
    found = best.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "label")))).alias("tags"))  # one entry a distinct character
    return seqs.join(F.broadcast(found)).select("sent_id", F.transform("cols", lambda r: F.get(r, F.lit(0))).alias("chars"), "labels", F.transform("cols", lambda r: F.col("tags")[F.get(r, F.lit(0))]).alias("predicted"))


def _trained(spark: SparkSession, sf_dir: str, algorithm: str = "l-bfgs"):
    return CrfEstimator(params=Params(algorithm=algorithm)).fit(_sequences(spark, sf_dir))


def q17_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best labels of every line under a trained model."""
    model = _trained(spark, sf_dir)
    out = tagged(model.encode(_sequences(spark, sf_dir)), model.arrays())
    return out.select("sent_id", F.round("score", 6).alias("score"), "tags")


def q18_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most likely label's mean probability of every line, and log Z, under the same model."""
    model = _trained(spark, sf_dir)
    p = certainties(model.encode(_sequences(spark, sf_dir)), model.arrays())
    return p.select("sent_id", F.round("log_z", 6).alias("log_z"), F.round("certainty", 6).alias("certainty"))


def q19_words_with_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(_by_character(spark, sf_dir), "predicted", "spans")
    return rows.select("sent_id", F.size("spans").cast("long").alias("n_words"), F.array_join(words(F.col("chars"), F.col("spans")), " ").alias("text"))


def q20_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.error_rates(_by_character(spark, sf_dir))
    return got.select("n_tok", "bad_tok", "n_sent", "bad_sent", F.round("token_error", 9).alias("token_error"), F.round("sentence_error", 9).alias("sentence_error"))


def q21_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.word_scores(_by_character(spark, sf_dir))
    return got.select("gold_w", "pred_w", "hit_w", *[F.round(c, 9).alias(c) for c in ("p", "r", "f1")])


def q22_model_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = q08_label_ids(spark, sf_dir).count()
    return metrics.model_statistics(Tpl.distinct(_sequences(spark, sf_dir), TEMPLATES).select("obs").distinct(), n)


def q23_stopping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopping rules over a log with one row a day of events: share of purchases as error, summed value as objective."""
    days = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("err"), F.round(F.sum("value"), 2).alias("obj"))
    log = days.withColumn("iter", F.row_number().over(Window.orderBy("day"))).select("iter", "err", "obj")
    return metrics.stopping(log).select("iter", F.round("spread", 6).alias("spread"), F.round("change", 6).alias("change"), "stop")


def q24_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as column files: sequences between blank lines, fields between spaces."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))
    rows = S.parse_rows(S.sequences_of(pages), False)
    fields = F.aggregate("cols", F.lit(0), lambda a, r: a + F.size(r))
    return rows.groupBy("file").agg(F.count("*").alias("n_seq"), F.sum(F.size("lines")).alias("n_lines"), F.sum(fields).alias("n_fields"))


def q25_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines among lines that have no such field; invalid ones are skipped."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("source", F.col("text").alias("cut"))).alias("value"))
    props = _table(spark, sf_dir, "events").select((-F.col("event_id") - 1).alias("doc_id"), F.col("props").alias("value"))
    return S.from_json_lines(docs.unionByName(props)).select("doc_id", F.char_length("cut").cast("long").alias("n"))


def q26_locked_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations of conversations are in the dictionary of documents, by template."""
    dictionary = materialize(_dictionary(spark, sf_dir), "dictionary")
    talks = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    featured = Tpl.features(S.from_segmented(S.lines_of(talks, "id", "text"), "sent_id", "line"), TEMPLATES)
    found = encode(featured, dictionary, q08_label_ids(spark, sf_dir)).select(F.explode("obs").alias("obs_id")).groupBy("obs_id").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(t.source.split(":")[0]) for t in TEMPLATES])
    known = found.join(dictionary, "obs_id").groupBy((F.array_position(names, F.substring_index("obs", ":", 1)) - 1).cast("int").alias("k")).agg(F.sum("n").alias("n_known"))
    every = featured.agg(F.sum(F.size("obs")).alias("n"), F.lit(len(TEMPLATES)).alias("m")).select("n", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("k"))
    return every.join(F.broadcast(known), "k", "left").select("k", "n", F.coalesce("n_known", F.lit(0)).alias("n_known"))


def q27_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.samples(q02_bmes_tags(spark, sf_dir))


def q28_training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir).log


def q29_training_log_sgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, "sgd-l1").log


def q30_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, white space taken out, segmented by a model of the documents."""
    texts = _table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", " ", ""))
    return _trained(spark, sf_dir).segment(texts, "text").select("item_id", "segmented")


def q32_column_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written as column files with their tags, and read again by splits."""
    path = f"{shared_dir(spark).rstrip('/')}/columns-{uuid.uuid4().hex}"
    S.write_sequences(_sequences(spark, sf_dir), path)
    chars = F.transform("cols", lambda r: F.get(r, F.lit(0)))
    return S.read_sequences(spark, path, True).select("sent_id", F.array_join(chars, "").alias("chars"), F.array_join("labels", "").alias("tags"))


def q33_viterbi_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best labels of every line and their score under the weights of q31; there are ties, which go to the lower label ids."""
    model, encoded = _weighted(spark, sf_dir)
    return tagged(encoded, model.arrays())


def q34_marginals_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log Z of every line and the probability of each label at its middle position, under the weights of q31."""
    model, encoded = _weighted(spark, sf_dir)
    arrays = model.arrays()
    rows = certainties(encoded, arrays).select("sent_id", "log_z", F.posexplode("middle").alias("k", "p"))
    names = F.array(*[F.lit(x) for x in arrays.labels])
    return rows.select("sent_id", F.get(names, F.col("k")).alias("label"), F.round("log_z", 3).alias("log_z"), F.round("p", 4).alias("p"))


def q37_first_trial_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objective with its penalties at zero and at the first point that the line search tries, and that point's weights that are not zero."""
    model, encoded, arrays = _prepared(spark, sf_dir)
    p, seen = Params(max_iter=1, max_line_search=1), []
    objective = objective_of(encoded, arrays, p, decoded=False)

    def valued(x):
        f, g = objective(x)
        seen.append((f, int((x != 0).sum())))
        return f, g

    lbfgs(valued, arrays.theta, p, lambda k, f, x: True)
    (start, _), (trial, n) = seen[0], seen[-1]
    return spark.createDataFrame([(float(round(start)), float(round(trial)), n)], "start double, trial double, n_active long")


def q35_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their numbers of characters, and the longest ones."""
    return metrics.lengths(_sequences(spark, sf_dir))


def q36_decoded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of all lines encoded to ids, and the ids back to text."""
    model, encoded = CrfEstimator().prepare(_sequences(spark, sf_dir))
    return D.strings_of(counted(encoded), model.layout).select("obs", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in sorted(globals().items()) if k[0] == "q" and k[1:3].isdigit()}

# --- oracle SQL ------------------------------------------------------------------------

_LINES = """
    parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id * 1000000 + i AS sent_id, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM parts)),
    seqs AS (SELECT sent_id, list_filter(list_transform(string_split_regex(line, '\\s+'), lambda w: ltrim(w, '[')), lambda w: w <> '') AS w FROM lines),
    words AS (SELECT sent_id, w FROM seqs WHERE len(w) > 0),
    sents AS (
        SELECT sent_id, w, string_split(array_to_string(w, ''), '') AS c,
            array_to_string(list_transform(w, lambda x: CASE WHEN length(x) = 1 THEN 'S' ELSE 'B' || repeat('M', length(x) - 2) || 'E' END), '') AS tags
        FROM words
    )"""
_CELLS = _LINES + """,
    cells AS (SELECT sent_id, len(c) AS n, c, tags, unnest(range(0, len(c))) AS t FROM sents)"""


def _cell(offset: int) -> str:
    """c[t + offset] with the marks outside."""
    at = f"(t + {offset})"
    return f"CASE WHEN {at} < 0 THEN '_x-' || CASE WHEN -{at} > 4 THEN '#' ELSE (-{at})::VARCHAR END WHEN {at} >= n THEN '_x+' || CASE WHEN {at} - n + 1 > 4 THEN '#' ELSE ({at} - n + 1)::VARCHAR END ELSE c[{at} + 1] END"


_DEFAULT = ["'u00:' || x0", "'u01:' || x1", "'u02:' || x2", "'u03:' || x3", "'u04:' || x4", "'u05:' || x1 || '/' || x2", "'u06:' || x2 || '/' || x3", "'u07:' || x0 || '/' || x1", "'u08:' || x3 || '/' || x4", "'u09:' || x1 || '/' || x3", "'b'"]
_OBS = _CELLS + f""",
    near AS (SELECT sent_id, t, tags, {", ".join(f"{_cell(k - 2)} AS x{k}" for k in range(5))} FROM cells),
    obs AS (SELECT sent_id, t, tags[t + 1] AS label, CASE WHEN t > 0 THEN tags[t] END AS previous, unnest([{", ".join(_DEFAULT)}]) AS obs, unnest(range(0, {len(_DEFAULT)})) AS k FROM near)"""
_FIRST = _OBS + """,
    ids AS (SELECT row_number() OVER (ORDER BY f) - 1 AS obs_id, obs FROM (SELECT obs, min((sent_id, t, k)) AS f FROM obs GROUP BY obs))"""
_LABELS = """
    label_ids AS (SELECT row_number() OVER (ORDER BY f) - 1 AS label_id, label FROM (SELECT tags[t + 1] AS label, min((sent_id, t)) AS f FROM cells GROUP BY 1))"""
_COUNTS = _OBS + """,
    counts AS (
        SELECT obs, '' AS previous, label, count(*) AS n FROM obs WHERE obs LIKE 'u%' GROUP BY 1, 2, 3
        UNION ALL SELECT obs, previous, label, count(*) AS n FROM obs WHERE obs LIKE 'b%' AND previous IS NOT NULL GROUP BY 1, 2, 3
    )"""
_GRADIENT = _COUNTS + """,
    names AS (SELECT DISTINCT label FROM obs),
    total AS (SELECT obs, sum(n) AS m FROM counts GROUP BY 1),
    places AS (SELECT '' AS previous, label, 'u' AS kind FROM names UNION ALL SELECT p.label, y.label, 'b' FROM names p CROSS JOIN names y),
    gradient AS (
        SELECT total.obs, places.previous, places.label, round(m / (SELECT count(*) FROM places p WHERE p.kind = places.kind) - coalesce(n, 0), 6) AS g
        FROM total JOIN places ON total.obs[1] = places.kind LEFT JOIN counts ON counts.obs = total.obs AND counts.label = places.label AND counts.previous = places.previous
    ),
    pseudo AS (SELECT obs, previous, label, round(CASE WHEN g + 0.5::DOUBLE < 0 THEN g + 0.5::DOUBLE WHEN g - 0.5::DOUBLE > 0 THEN g - 0.5::DOUBLE ELSE 0 END, 6) AS pg FROM gradient)"""
_GUESS = _CELLS + """,
    tally AS (SELECT c[t + 1] AS ch, tags[t + 1] AS label, count(*) AS n FROM cells GROUP BY 1, 2),
    best AS (SELECT ch, label FROM tally QUALIFY row_number() OVER (PARTITION BY ch ORDER BY n DESC, label) = 1),
    guess AS (SELECT sent_id, t, c[t + 1] AS ch, tags[t + 1] AS gold, best.label AS found FROM cells JOIN best ON best.ch = c[t + 1]),
    flags AS (
        SELECT *, (t = 0 OR found IN ('B', 'S') OR lag(found) OVER w IN ('E', 'S'))::INT AS starts,
            (t = 0 OR gold IN ('B', 'S') OR lag(gold) OVER w IN ('E', 'S'))::INT AS gold_starts
        FROM guess WINDOW w AS (PARTITION BY sent_id ORDER BY t)
    ),
    numbered AS (
        SELECT *, sum(starts) OVER w AS word, sum(gold_starts) OVER w AS gold_word FROM flags WINDOW w AS (PARTITION BY sent_id ORDER BY t)
    ),
    found_words AS (SELECT sent_id, word, min(t) AS a, max(t) AS b, string_agg(ch, '' ORDER BY t) AS w FROM numbered GROUP BY 1, 2),
    gold_words AS (SELECT sent_id, gold_word, min(t) AS a, max(t) AS b FROM numbered GROUP BY 1, 2)"""


#: Lists of a line's label scores by position under the weights of q31, and the pairs' weights w[previous][label], labels in order of their ids.
_SCORES = _OBS + "," + _LABELS + """,
    names AS (SELECT list(label ORDER BY label_id) AS names FROM label_ids),
    w AS (SELECT names, list_transform(names, lambda x: list_transform(names, lambda y: (ascii(x) * 3 + ascii(y)) % 11 / 8.0)) AS w FROM names),
    sums AS (SELECT sent_id, t, sum(length(obs) % 7)::INT AS a, sum(strlen(obs) % 5)::INT AS b FROM obs WHERE obs LIKE 'u%' GROUP BY 1, 2)"""


def _log_sums(x: str) -> str:
    """Log of the sum of exponentials of a list."""
    return f"list_max({x}) + ln(list_sum(list_transform({x}, lambda z: exp(z - list_max({x})))))"


def _absolute(row: str) -> str:
    return f"CASE WHEN {row} < 0 THEN '_x-' || (-({row}))::VARCHAR WHEN {row} >= n THEN '_x+' || ({row} - n + 1)::VARCHAR ELSE c[{row} + 1] END"


_FAR = [f"'u0:' || ({_absolute('0')})", f"'u1:' || ({_absolute('(n - 1)')})", "'u2:_x-1'", f"'u3:' || ({_cell(-6)})", f"'u4:' || ({_cell(5)})", f"'u5:' || ({_cell(-4)}) || '/' || ({_cell(4)})", f"'*6:' || ({_absolute('1')})"]
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PATTERNS = [
    f"'u0:' || regexp_matches({_cell(0)}, '^[A-Z]$')::VARCHAR", f"'u1:' || regexp_extract({_cell(0)}, '[0-9]')", f"'u2:' || translate({_cell(0)}, {_ASCII})",
    f"'u3:' || regexp_matches({_cell(-1)}, 'x')::VARCHAR", "'u4:'", f"'u5:' || regexp_matches({_cell(0)}, '[A-Za-z0-9]')::VARCHAR",
]


def _grouped(items: list[str]) -> str:
    return f"WITH {_CELLS}, o AS (SELECT unnest([{', '.join(items)}]) AS obs, unnest(range(0, {len(items)}))::INT AS k FROM cells) "


_TEMPLATE = "count(*) AS n, count(DISTINCT obs) AS n_distinct, sum(length(obs))::BIGINT AS n_chars"
ORACLE_SQL: dict[str, str] = {
    "q01_characters": f"WITH {_LINES} SELECT sent_id, len(c)::BIGINT AS n, array_to_string(c, '|') AS chars FROM sents",
    "q02_bmes_tags": f"WITH {_LINES} SELECT sent_id, tags FROM sents",
    "q03_text_from_tags": f"WITH {_LINES} SELECT sent_id, array_to_string(w, ' ') AS text FROM sents",
    "q04_default_features": f"WITH {_OBS} SELECT k::INT AS k, {_TEMPLATE} FROM obs GROUP BY 1",
    "q05_absolute_and_far": _grouped(_FAR) + f"SELECT k, {_TEMPLATE} FROM o GROUP BY 1",
    "q06_patterns_and_case": _grouped(_PATTERNS) + "SELECT k, obs, count(*) AS n FROM o GROUP BY 1, 2",
    "q07_observation_ids": f"WITH {_FIRST} SELECT obs_id, obs FROM ids",
    "q08_label_ids": f"WITH {_CELLS}, {_LABELS} SELECT label_id, label FROM label_ids",
    "q09_feature_layout": f"""
        WITH {_FIRST}, y AS (SELECT count(DISTINCT label) AS y FROM obs),
        wide AS (SELECT obs_id, obs, CASE WHEN obs LIKE 'u%' THEN y ELSE y * y END AS w FROM ids, y),
        placed AS (SELECT obs_id, obs, coalesce(sum(w) OVER (ORDER BY obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM wide)
        SELECT obs_id, obs, CASE WHEN obs LIKE 'u%' THEN 1 ELSE 2 END AS kind, CASE WHEN obs LIKE 'u%' THEN o ELSE -1 END AS uoff, CASE WHEN obs LIKE 'b%' THEN o ELSE -1 END AS boff FROM placed
    """,
    "q10_empirical_counts": f"WITH {_COUNTS} SELECT obs, previous, label, n FROM counts",
    "q11_label_transitions": f"WITH {_OBS} SELECT obs, previous, label, count(*) AS n FROM obs WHERE obs LIKE 'b%' AND previous IS NOT NULL GROUP BY 1, 2, 3",
    "q12_objective_at_zero": f"WITH {_CELLS} SELECT count(DISTINCT sent_id) AS n_sent, round(count(*) * ln(count(DISTINCT tags[t + 1])), 2) AS loss FROM cells",
    "q13_gradient_at_zero": f"WITH {_GRADIENT} SELECT obs, previous, label, g FROM gradient",
    "q14_pseudo_gradient": f"WITH {_GRADIENT} SELECT obs, previous, label, pg FROM pseudo",
    "q15_first_trial": f"WITH {_GRADIENT} SELECT obs, previous, label, round(-pg / (SELECT sqrt(sum(pg * pg)) FROM pseudo), 7) AS x FROM pseudo WHERE pg <> 0",
    "q16_unigram_potentials": f"""
        WITH {_OBS}, p AS (SELECT sent_id, sum(length(obs) % 7) AS a, sum(strlen(obs) % 5) AS b FROM obs WHERE obs LIKE 'u%' GROUP BY 1), names AS (SELECT DISTINCT label FROM obs)
        SELECT sent_id, label, ((a - b * length(label) + ascii(label) % 3) / 8.0)::DOUBLE AS score FROM p CROSS JOIN names
    """,
    "q31_potentials": f"""
        WITH {_OBS}, p AS (SELECT sent_id, sum(length(obs) % 7) AS a, sum(strlen(obs) % 5) AS b, max(t) AS steps FROM obs WHERE obs LIKE 'u%' GROUP BY 1), names AS (SELECT DISTINCT label FROM obs),
        pairs AS (SELECT y.label, sum((ascii(x.label) * 3 + ascii(y.label)) % 11) AS w FROM names x CROSS JOIN names y GROUP BY 1)
        SELECT sent_id, label, ((a - b * (ascii(label) % 3)) / 8.0)::DOUBLE AS score, (steps * w / 8.0)::DOUBLE AS "into" FROM p CROSS JOIN pairs
    """,
    "q19_words_with_repair": f"WITH {_GUESS} SELECT sent_id, count(*) AS n_words, string_agg(w, ' ' ORDER BY a) AS text FROM found_words GROUP BY 1",
    "q20_error_rates": f"""
        WITH {_GUESS}, s AS (SELECT sent_id, count(*) AS n, count(*) FILTER (gold <> found) AS bad FROM guess GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_tok, sum(bad)::BIGINT AS bad_tok, count(*) AS n_sent, count(*) FILTER (bad > 0) AS bad_sent,
            round(sum(bad) / sum(n), 9) AS token_error, round(count(*) FILTER (bad > 0) / count(*), 9) AS sentence_error FROM s
    """,
    "q21_word_scores": f"""
        WITH {_GUESS}, k AS (SELECT (SELECT count(*) FROM gold_words) AS g, (SELECT count(*) FROM found_words) AS f, (SELECT count(*) FROM gold_words x JOIN found_words y ON x.sent_id = y.sent_id AND x.a = y.a AND x.b = y.b) AS h)
        SELECT g AS gold_w, f AS pred_w, h AS hit_w, round(h / f, 9) AS p, round(h / g, 9) AS r, round(2 * (h / f) * (h / g) / (h / f + h / g), 9) AS f1 FROM k
    """,
    "q22_model_statistics": f"""
        WITH {_OBS}, o AS (SELECT DISTINCT obs FROM obs), y AS (SELECT count(DISTINCT label) AS y FROM obs)
        SELECT split_part(obs, ':', 1) AS template, count(*) AS n_obs, sum(CASE WHEN obs LIKE 'u%' THEN y ELSE y * y END)::BIGINT AS n_weights, sum(strlen(obs))::BIGINT AS n_bytes FROM o, y GROUP BY 1
    """,
    "q23_stopping_rules": """
        WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') / count(*) AS err, round(sum(value), 2) AS obj FROM events GROUP BY 1),
        l AS (SELECT row_number() OVER (ORDER BY day)::INT AS iter, err, obj FROM d),
        s AS (SELECT iter, CASE WHEN count(err) OVER w = 5 THEN (max(err) OVER w - min(err) OVER w) * 100 END AS spread,
            CASE WHEN iter > 5 THEN abs(lag(obj, 4) OVER (ORDER BY iter) - obj) / abs(obj) END AS change FROM l WINDOW w AS (ORDER BY iter ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT iter, round(spread, 6) AS spread, round(change, 6) AS change, coalesce(spread < 0.02, false) OR coalesce(change < 0.02, false) AS stop FROM s
    """,
    "q24_sequence_files": """
        WITH l AS (SELECT page_id AS file, unnest(string_split(html, chr(10))) AS line, unnest(range(0, len(string_split(html, chr(10))))) AS place FROM pages),
        x AS (SELECT file, place, trim(line, ' ' || chr(9) || chr(13) || chr(10)) AS line FROM l),
        g AS (SELECT file, line, sum((line = '')::INT) OVER (PARTITION BY file ORDER BY place) AS seq FROM x)
        SELECT file, count(DISTINCT seq) AS n_seq, count(*) AS n_lines, sum(len(list_filter(string_split(line, ' '), lambda f: f <> '')))::BIGINT AS n_fields FROM g WHERE line <> '' GROUP BY 1
    """,
    "q25_json_lines": """
        WITH v AS (SELECT doc_id, to_json({'source': source, 'cut': text}) AS value FROM documents UNION ALL SELECT -event_id - 1, CASE WHEN json_valid(props) THEN props END FROM events)
        SELECT doc_id, length(value ->> '$.cut')::BIGINT AS n FROM v WHERE json_type(value, '$.cut') = 'VARCHAR'
    """,
    "q26_locked_dictionary": f"""
        WITH {_OBS}, known AS (SELECT DISTINCT obs FROM obs), talk AS (
            WITH {_OBS.replace('FROM documents', 'FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')} SELECT k, obs FROM obs
        ) SELECT k::INT AS k, count(*) AS n, count(known.obs) AS n_known FROM talk LEFT JOIN known ON known.obs = talk.obs GROUP BY 1
    """,
    "q27_first_samples": f"WITH {_LINES} SELECT sent_id, tags FROM sents ORDER BY sent_id LIMIT 10",
    "q32_column_file_scan": f"WITH {_LINES} SELECT row_number() OVER (ORDER BY sent_id) - 1 AS sent_id, array_to_string(c, '') AS chars, tags FROM sents",
    "q33_viterbi_of_weights": f"""
        WITH {_SCORES},
        lists AS (
            SELECT sent_id, any_value(w) AS w, list({{'v': list_transform(names, lambda y: ((a - b * (ascii(y) % 3)) / 8.0)::DOUBLE), 'p': names}} ORDER BY t) AS l
            FROM sums, w GROUP BY 1
        ),
        last AS (
            SELECT sent_id, list_reduce(l, lambda r, x: {{
                'v': list_transform(x.v, lambda e, j: e + list_max(list_transform(r.v, lambda z, i: z + w[i][j]))),
                'p': list_transform(x.p, lambda e, j: r.p[list_position(list_transform(r.v, lambda z, i: z + w[i][j]), list_max(list_transform(r.v, lambda z, i: z + w[i][j])))] || e)
            }}) AS r FROM lists
        )
        SELECT sent_id, list_max(r.v) AS score, r.p[list_position(r.v, list_max(r.v))] AS tags FROM last
    """,
    "q34_marginals_of_weights": f"""
        WITH {_SCORES},
        lists AS (
            SELECT sent_id, any_value(names) AS names, any_value(w) AS w, list(list_transform(names, lambda y: ((a - b * (ascii(y) % 3)) / 8.0)::DOUBLE) ORDER BY t) AS l FROM sums, w GROUP BY 1
        ),
        halves AS (
            SELECT sent_id, names, l[len(l) // 2 + 1] AS u,
                list_reduce(l[1:len(l) // 2 + 1], lambda r, x: list_transform(x, lambda e, j: e + {_log_sums("list_transform(r, lambda z, i: z + w[i][j])")})) AS f,
                list_reduce(list_reverse(l[len(l) // 2 + 1:]), lambda r, x: list_transform(x, lambda e, i: e + {_log_sums("list_transform(r, lambda z, j: z + w[i][j])")})) AS g
            FROM lists
        ),
        both_ AS (SELECT sent_id, names, list_transform(f, lambda z, i: z + g[i] - u[i]) AS s FROM halves),
        total AS (SELECT sent_id, names, s, {_log_sums("s")} AS log_z FROM both_)
        SELECT sent_id, unnest(names) AS label, round(log_z, 3) AS log_z, round(unnest(list_transform(s, lambda z: exp(z - log_z))), 4) AS p FROM total
    """,
    "q35_lengths": f"""
        WITH {_LINES} SELECT (floor(log2(len(c))) + 1)::INT AS step, count(*) AS n_seq, sum(len(c))::BIGINT AS n_pos, max(len(c))::INT AS longest FROM sents GROUP BY 1
    """,
    "q36_decoded_ids": f"WITH {_OBS} SELECT obs, count(*) AS n FROM obs GROUP BY 1",
    "q37_first_trial_value": f"""
        WITH {_GRADIENT},
        x AS (SELECT obs, previous, label, -pg / (SELECT sqrt(sum(pg * pg)) FROM pseudo) AS x FROM pseudo WHERE pg <> 0),
        ns AS (SELECT list(label ORDER BY label) AS ns FROM names),
        own AS (SELECT obs, [{", ".join(f"coalesce(max(x) FILTER (label = ns[{k}]), 0)" for k in range(1, 5))}] AS v FROM x, ns WHERE obs LIKE 'u%' GROUP BY obs),
        pairs AS (SELECT list(row_ ORDER BY previous) AS w FROM (
            SELECT a.label AS previous, list(coalesce(x.x, 0) ORDER BY b.label) AS row_ FROM names a CROSS JOIN names b LEFT JOIN x ON x.obs = 'b' AND x.previous = a.label AND x.label = b.label GROUP BY 1)),
        u AS (
            SELECT sent_id, t, any_value(label) AS label, any_value(previous) AS previous, [{", ".join(f"coalesce(sum(v[{k}]), 0)" for k in range(1, 5))}] AS u
            FROM obs LEFT JOIN own ON own.obs = obs.obs WHERE obs.obs LIKE 'u%' GROUP BY 1, 2
        ),
        gold AS (SELECT sum(u[list_position(ns, label)] + CASE WHEN t > 0 THEN w[list_position(ns, previous)][list_position(ns, label)] ELSE 0 END) AS g FROM u, ns, pairs),
        lists AS (SELECT sent_id, any_value(w) AS w, list(u ORDER BY t) AS l FROM u, pairs GROUP BY 1),
        last AS (SELECT list_reduce(l, lambda r, x: list_transform(x, lambda e, j: e + {_log_sums("list_transform(r, lambda z, i: z + w[i][j])")})) AS f FROM lists),
        z AS (SELECT sum({_log_sums("f")}) AS z FROM last)
        SELECT round((SELECT count(*) FROM cells) * ln((SELECT count(*) FROM names))) AS start,
            round(z - g + (SELECT 0.5 * sum(abs(x)) + 0.0001 * sum(x * x) / 2 FROM x)) AS trial, (SELECT count(*) FROM x) AS n_active FROM z, gold
    """,
}
