"""Queries over tokens, TF-IDF, event sequences, embeddings and scaling."""

from pyspark.sql import functions as F

from logtide.functions import text as T
from logtide.operators import context, embed, events, factor, lexical, units
from logtide.operators.skew import salted_lookup
from logtide.plans import views as V
from logtide.plans.catalog import register
from logtide.plans.catalog_joins import _TOKEN_CTE, _chat_tokens, _token_vectors
from logtide.runtime import stored


# What ordered sequences need of a session.
_SEQUENCE = ("unit_id", "segment", "offset", "event_count", "log_keys", "lead_key", "trail_key", "_target", "_split")


def _train(built):
    return built.where(F.col("_split") == "train")


@register("SELECT item_id, array_to_string(regexp_extract_all(text, '\\S+'), '|') AS tokens FROM benchmark")
def whitespace_tokens(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.array_join(T.whitespace_tokens(F.col("text")), "|").alias("tokens"))


@register(
    f"""WITH {V.CHATS} SELECT row_id, array_to_string({V.WORDS_SQL}, '|') AS words, len(regexp_extract_all(_text, '{T.ALPHA_START_WORD}')) AS alpha_words FROM chat"""
)
def word_tokens(spark, d):
    t = F.col("_text")
    return V.chat_rows(spark, d).select(
        "row_id", F.array_join(T.word_tokens(t), "|").alias("words"), T.alpha_token_count(t).cast("bigint").alias("alpha_words")
    )


@register(
    f"""WITH {V.CHATS} SELECT row_id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))), '|') AS terms
    FROM (SELECT row_id, {V.WORDS_SQL} AS w FROM chat)"""
)
def unigrams_and_bigrams(spark, d):
    rows = V.chat_rows(spark, d).select("row_id", T.word_tokens(F.col("_text")).alias("words"))
    terms = F.concat("words", T.bigrams(F.col("words")))
    return rows.select("row_id", F.array_join(terms, "|").alias("terms"))


_DOC_UNITS = f"{V.DOCUMENTS}, du AS (SELECT CAST(row_id AS VARCHAR) AS unit_id, _text, _split, _target FROM docs)"
_LOG_UNITS = f"{V.PREPARED}, lu AS (SELECT CAST(row_id AS VARCHAR) AS unit_id, _text, _split, _target FROM prep)"


@register(f"WITH {_DOC_UNITS}, {V.lexicon_sql('du', 20000)} SELECT term, tf, df FROM lex")
def document_vocabulary(spark, d):
    return lexical.vocabulary(lexical.term_frequencies(_train(V.document_units(spark, d))), lexical.LOG_FEATURES)


@register(f"WITH {V.CHATS}, {V.lexicon_sql('chats', 25000)} SELECT term, tf, df, round(idf, 6) AS idf FROM lex")
def session_vocabulary_idf(spark, d):
    built = _train(V.chat_sessions(spark, d))
    vocabulary = lexical.vocabulary(lexical.term_frequencies(built), lexical.SESSION_FEATURES)
    n = built.heads.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vocabulary.withColumn("idf", F.round(lexical.smooth_idf(F.col("df"), n), 6))


def _weights_sql(source: str, cap: int) -> str:
    return f"""{V.lexicon_sql(source, cap)}, entries AS (
    SELECT t.unit_id, t.term, count(*) AS tf, (1 + ln(count(*))) * any_value(l.idf) AS w FROM terms t JOIN lex l ON t.term = l.term GROUP BY 1, 2), norm AS (
    SELECT unit_id, sqrt(sum(w * w)) AS n FROM entries GROUP BY 1), weights AS (
    SELECT e.unit_id, e.term, e.tf, e.w / n.n AS weight FROM entries e JOIN norm n ON e.unit_id = n.unit_id)"""


@register(f"WITH {_LOG_UNITS}, {_weights_sql('lu', 20000)} SELECT unit_id, term, round(weight, 6) AS weight FROM weights")
def log_tfidf_weights(spark, d):
    built = units.log_units(V.prepared_logs(spark, d))
    lexicon = lexical.fit_lexicon(_train(built))
    return _vector_rows(lexical.term_weights(built, lexicon), lexicon)


def _vector_rows(weights, lexicon):
    return lexical.weight_entries(weights, lexicon).withColumn("weight", F.round("weight", 6))


@register(f"WITH {V.CHATS}, {_weights_sql('chats', 25000)} SELECT unit_id, term, round(weight, 6) AS weight FROM weights")
def session_tfidf_vectors(spark, d):
    """The weights of whole sessions, entry by entry."""
    built = V.chat_sessions(spark, d)
    lexicon = lexical.fit_lexicon(_train(built), lexical.SESSION_FEATURES)
    return _vector_rows(lexical.term_weights(built, lexicon), lexicon)


@register(f"WITH {V.CHATS}, {_weights_sql('chats', 25000)} SELECT unit_id, term, round(weight, 6) AS weight FROM weights")
def segmented_session_tfidf(spark, d):
    """The same vectors from sessions held as two-event segments: segment borders must not show."""
    built = units.session_units(V.chat_rows(spark, d), limit=2)
    lexicon = lexical.fit_lexicon(_train(built), lexical.SESSION_FEATURES)
    return _vector_rows(lexical.term_weights(built, lexicon), lexicon)


@register(f"WITH {_DOC_UNITS}, {_weights_sql('du', 20000)} SELECT u.unit_id, count(w.term) AS entries, round(coalesce(sum(w.weight), 0), 4) AS total, round(max(w.weight), 6) AS top FROM du u LEFT JOIN weights w ON u.unit_id = w.unit_id GROUP BY 1")
def document_tfidf_vectors(spark, d):
    built = V.document_units(spark, d)
    lexicon = lexical.fit_lexicon(_train(built))
    values = lexical.term_weights(built, lexicon).select("unit_id", F.col("_w").alias("v"))
    return values.select(
        "unit_id",
        F.size("v").cast("bigint").alias("entries"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
        F.round(F.array_max("v"), 6).alias("top"),
    )


@register(
    f"""WITH {V.SESSIONS}, tr AS (SELECT unit_id, unnest(log_keys) AS key FROM sess WHERE _split = 'train')
    SELECT key, count(DISTINCT unit_id) AS df, round(ln((1 + (SELECT count(*) FROM sess WHERE _split = 'train')) / CAST(1 + count(DISTINCT unit_id) AS DOUBLE)) + 1, 6) AS idf FROM tr GROUP BY 1"""
)
def event_key_idf(spark, d):
    return lexical.key_idf(_train(V.event_sessions(spark, d))).withColumn("idf", F.round("idf", 6))


_KEY_IDS = """keys AS (SELECT key, row_number() OVER (ORDER BY key) + 3 AS id FROM (SELECT DISTINCT unnest(log_keys) AS key FROM sess WHERE _split = 'train'))"""


@register(
    f"""WITH {V.SESSIONS}, {_KEY_IDS} SELECT key, id FROM keys UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[DIST]', 1), ('[MASK]', 2), ('[UNK]', 3))"""
)
def event_key_vocabulary(spark, d):
    return events.key_vocabulary(_train(V.event_sessions(spark, d)))


@register(
    f"""WITH {V.SESSIONS}, {_KEY_IDS}, longest AS (SELECT max(event_count) AS m FROM sess WHERE _split = 'train'),
    ev AS (SELECT unit_id, unnest(log_keys) AS key, unnest(range(1, len(log_keys) + 1)) AS pos FROM sess)
    SELECT ev.unit_id, array_to_string(list(coalesce(k.id, 3) ORDER BY pos), ',') AS ids FROM ev LEFT JOIN keys k ON ev.key = k.key WHERE pos <= (SELECT m FROM longest) GROUP BY 1"""
)
def event_key_sequences(spark, d):
    built = V.kept_sessions(spark, d, *_SEQUENCE)
    train = _train(built)
    mapped = events.key_sequences(built, events.key_vocabulary(train), events.longest_session(train))
    return mapped.select("unit_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_MASKED = f"""{V.CHATS}, ev AS (SELECT unit_id, _split, _target, event_count, unnest(log_keys) AS key, unnest(range(1, len(log_keys) + 1)) AS position FROM chats), ctx AS (
 SELECT *, coalesce(lag(key) OVER o, '[DIST]') AS previous, coalesce(lead(key) OVER o, '[PAD]') AS following,
  row_number() OVER (PARTITION BY unit_id ORDER BY md5(concat('42:', unit_id, ':', position)), position)
   <= greatest(1, CAST(round_even(event_count * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) AS masked
 FROM ev WINDOW o AS (PARTITION BY unit_id ORDER BY position))"""


@register(f"WITH {_MASKED} SELECT unit_id, position, key, previous, following, masked FROM ctx")
def event_masking(spark, d):
    rows = events.masked_events(events.session_events(V.chat_sessions(spark, d)))
    return rows.select("unit_id", "position", "key", "previous", "following", "masked")


@register(f"WITH {_MASKED} SELECT unit_id, position, key, previous, following, masked FROM ctx")
def segmented_event_masking(spark, d):
    """The same events from sessions held as two-event segments and ranked by running totals."""
    built = units.session_units(V.chat_rows(spark, d), limit=2)
    rows = events.masked_events(events.session_events(built), limit=1)
    return rows.select("unit_id", "position", "key", "previous", "following", "masked")


@register(
    f"""WITH {_MASKED}, base AS (SELECT * FROM ctx WHERE _split = 'train' AND _target = 0), seen AS (
    SELECT previous, following, key, count(*) AS n FROM base GROUP BY ALL), tot AS (SELECT previous, following, count(*) AS n FROM base GROUP BY ALL)
    SELECT c.unit_id, round(avg(-ln((coalesce(s.n, 0) + 1) / (coalesce(t.n, 0) + CAST((SELECT count(DISTINCT key) FROM base) AS DOUBLE)))), 6) AS surprise
    FROM ctx c LEFT JOIN seen s ON c.previous = s.previous AND c.following = s.following AND c.key = s.key
    LEFT JOIN tot t ON c.previous = t.previous AND c.following = t.following WHERE c.masked GROUP BY 1"""
)
def masked_event_surprise(spark, d):
    rows = events.masked_events(events.session_events(V.chat_sessions(spark, d)))
    normal = rows.where((F.col("_split") == "train") & (F.col("_target") == 0))
    keys = normal.select("key").distinct().count()
    found = events.session_surprise(rows, events.context_model(normal), keys)
    return found.withColumn("surprise", F.round("surprise", 6))


_FIRST = "round(sum(v.vector[{0}] * {1}) / sum({1}), 9) AS m{0}"


@register(
    f"WITH {_TOKEN_CTE} SELECT t.unit_id, " + ", ".join(_FIRST.format(i, "1") for i in (1, 2, 3, 4)) + " FROM toks t JOIN vec v ON t.token = v.token GROUP BY 1"
)
def mean_token_embedding(spark, d):
    tokens = _chat_tokens(spark, d)
    means = embed.token_means(tokens, _token_vectors(tokens).drop("weight"))
    return means.select("unit_id", *[F.round(F.col("mean")[i], 9).alias(f"m{i + 1}") for i in range(4)])


@register(
    f"WITH {_TOKEN_CTE} SELECT t.unit_id, " + ", ".join(_FIRST.format(i, "v.weight") for i in (1, 2, 3, 4)) + " FROM toks t JOIN vec v ON t.token = v.token GROUP BY 1"
)
def weighted_token_embedding(spark, d):
    tokens = _chat_tokens(spark, d)
    vectors = _token_vectors(tokens)
    means = embed.token_means(tokens, vectors.drop("weight"), vectors.select("token", "weight"))
    return means.select("unit_id", *[F.round(F.col("mean")[i], 9).alias(f"m{i + 1}") for i in range(4)])


@register(
    f"""WITH {_TOKEN_CTE} SELECT c.row_id AS unit_id, round(coalesce(sum(v.vector[1]) / count(v.token), 0), 6) AS m1, CAST(count(v.token) AS DOUBLE) AS known
    FROM chat c LEFT JOIN toks t ON c.row_id = t.unit_id LEFT JOIN vec v ON t.token = v.token GROUP BY 1"""
)
def row_wise_mean_embedding(spark, d):
    """A mean for every row, zeros without known tokens; the vocabulary stays a table, whatever its size."""
    tokens = _chat_tokens(spark, d)
    means = embed.token_means(tokens, _token_vectors(tokens).drop("weight"))
    chats = V.chat_rows(spark, d).select(F.col("row_id").alias("unit_id"))
    found = chats.join(means, "unit_id", "left")
    first, known = (F.coalesce(c, F.lit(0.0)) for c in (F.col("mean")[0], F.col("mean_weight")))
    return found.select("unit_id", F.round(first, 6).alias("m1"), known.alias("known"))


@register(
    f"""WITH {V.DOCUMENTS}, uniq AS (SELECT DISTINCT _text FROM docs), feat AS (SELECT _text, len(string_split(_text, ' ')) AS tokens, md5(_text) AS digest FROM uniq)
    SELECT d.row_id, f.tokens, f.digest FROM docs d JOIN feat f ON d._text = f._text"""
)
def reuse_per_distinct_text(spark, d):
    # Cleaned once: the rows, their distinct texts and the counts of these are three reads.
    rows = stored(V.document_logs(spark, d).select("row_id", "_text"), "texts")
    features = rows.select("_text").distinct().select(
        "_text", F.size(F.split("_text", " ")).cast("bigint").alias("tokens"), F.md5(F.col("_text").cast("binary")).alias("digest")
    )
    return salted_lookup(rows, features, "_text", "inner").select("row_id", "tokens", "digest")


@register(
    """WITH long AS (SELECT vec_id, unnest(range(0, len(embedding))) AS dimension, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    s AS (SELECT dimension, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY 1)
    SELECT l.vec_id, l.dimension, round((l.v - s.m) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END, 5) AS value FROM long l JOIN s ON l.dimension = s.dimension"""
)
def standard_scaling(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = embed.scaled_by_dimension(rows, "embedding", ["vec_id"])
    return scaled.select("vec_id", F.col("dimension").cast("bigint").alias("dimension"), F.round("value", 5).alias("value"))


@register(
    """WITH long AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY 1) SELECT l.vec_id, round(sum((l.v - s.m) / s.sd), 5) AS total, round(max((l.v - s.m) / s.sd), 5) AS top
    FROM long l JOIN s ON l.dim = s.dim GROUP BY 1"""
)
def row_wise_scaling(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    scaled = rows.select("vec_id", embed.scaled(F.col("e"), embed.fit_scalings(rows, ["e"])[0]).alias("s"))
    return scaled.select(
        "vec_id",
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
        F.round(F.array_max("s"), 5).alias("top"),
    )


@register(
    """WITH long AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    c AS (SELECT dim, avg(v) AS m FROM long WHERE label >= 3 GROUP BY 1) SELECT l.vec_id, round(avg((l.v - c.m) * (l.v - c.m)), 6) AS distance FROM long l JOIN c ON l.dim = c.dim GROUP BY 1"""
)
def distance_to_normal_centre(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    centre = embed.centre_of(rows.where("label >= 3"), "e")
    return rows.select("vec_id", F.round(embed.squared_distance(F.col("e"), centre), 6).alias("distance"))


@register(
    """WITH long AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT label, dim AS dimension, round(sum(v * (1 + vec_id % 5)) / sum(1 + vec_id % 5), 5) AS value FROM long GROUP BY 1, 2"""
)
def weighted_vector_mean(spark, d):
    """IDF-weighted event embedding shape: weighted mean vectors per group by the ML summarizer."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = V.table(spark, d, "embeddings").select(
        "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"), (1 + F.col("vec_id") % 5).cast("double").alias("w")
    )
    means = rows.groupBy("label").agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m"))
    long = means.select("label", F.posexplode(vector_to_array("m")).alias("dimension", "value"))
    return long.select("label", F.col("dimension").cast("bigint").alias("dimension"), F.round("value", 5).alias("value"))


@register(
    f"""WITH {_LOG_UNITS}, t AS (SELECT unit_id, regexp_extract_all(_text, '\\S+') AS w FROM lu), p AS (SELECT unit_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM t),
    known AS (SELECT word FROM p GROUP BY 1 HAVING count(*) >= 2),
    near AS (SELECT a.word AS a, b.word AS b, 6 - (b.at - a.at) AS n FROM p a JOIN p b ON a.unit_id = b.unit_id AND b.at > a.at AND b.at <= a.at + 5),
    m AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM near UNION ALL SELECT b, a, n FROM near) WHERE a IN (FROM known) AND b IN (FROM known) GROUP BY ALL),
    s AS (SELECT a, sum(n) AS s FROM m GROUP BY 1), v AS (SELECT m.a, m.b, ln(n * (SELECT sum(n) FROM m)::DOUBLE / (x.s::DOUBLE * y.s)) AS value
      FROM m JOIN s x ON x.a = m.a JOIN s y ON y.a = m.b)
    SELECT a AS word, b AS near, round(value, 6) AS score FROM v WHERE value > 1e-6"""
)
def near_word_scores(spark, d):
    """The matrix that word vectors are factored from, over all logs, with words for numbers."""
    tokens = units.log_units(V.kept_logs(spark, d, "row_id", "_text")).frame.select(T.whitespace_tokens(F.col("_text")).alias("tokens"))
    words = factor.numbered_words(factor.word_counts(tokens, 2))
    found = factor.entries(factor.near_pairs(tokens, 5), words, 1.0).where("value > 1e-6")
    named = found.join(words.select(F.col("id").alias("i"), "word"), "i").join(words.select(F.col("id").alias("j"), F.col("word").alias("near")), "j")
    return named.select("word", "near", F.round("value", 6).alias("score"))


@register()
def log_word_embedding_features(spark, d):
    """Word vectors factored from train logs, then plain and IDF-weighted means, scaled, per log."""
    from pyspark.ml.functions import vector_to_array

    from logtide.plans.experiment import FeatureSpace, Settings

    built = units.log_units(V.kept_logs(spark, d, "row_id", "_text", "_split"))
    space = FeatureSpace.fit(_train(built), Settings(representation="concat").checked())
    parts = F.unwrap_udt(F.col("concat"))
    return space.transform(built).select(
        "unit_id",
        parts["size"].alias("size"),
        F.size(parts["values"]).alias("entries"),
        vector_to_array("embedding").alias("embedding"),
        vector_to_array("weighted").alias("weighted"),
    )


@register(
    f"""WITH {V.SESSIONS}, known AS (SELECT DISTINCT unnest(log_keys) AS k FROM sess WHERE _split = 'train'),
    e0 AS (SELECT unit_id, _split, _target, unnest(log_keys) AS k, generate_subscripts(log_keys, 1) AS i FROM sess),
    e1 AS (SELECT unit_id, _split, _target, i, CASE WHEN k IN (FROM known) THEN k ELSE '[UNK]' END AS k FROM e0
      WHERE i <= (SELECT max(event_count) FROM sess WHERE _split = 'train')),
    e AS (SELECT *, coalesce(lag(k) OVER w, '[DIST]') AS p, coalesce(lead(k) OVER w, '[PAD]') AS n FROM e1 WINDOW w AS (PARTITION BY unit_id ORDER BY i)),
    c3 AS (SELECT p, n, k, count(*) AS c FROM e WHERE _split = 'train' AND _target = 0 GROUP BY ALL), s3 AS (SELECT p, n, sum(c) AS c, count(*) AS d FROM c3 GROUP BY ALL),
    cl AS (SELECT p, k, sum(c) AS c FROM c3 GROUP BY ALL), sl AS (SELECT p, sum(c) AS c, count(*) AS d FROM cl GROUP BY ALL),
    cr AS (SELECT n, k, sum(c) AS c FROM c3 GROUP BY ALL), sr AS (SELECT n, sum(c) AS c, count(*) AS d FROM cr GROUP BY ALL),
    c1 AS (SELECT k, sum(c) AS c FROM c3 GROUP BY ALL),
    q1 AS (SELECT e.*, (coalesce(c1.c, 0) + 1) / CAST((SELECT sum(c) FROM c3) + (SELECT count(*) FROM known) + 1 AS DOUBLE) AS p1 FROM e LEFT JOIN c1 USING (k)),
    q2 AS (SELECT q1.*, CASE WHEN sl.c IS NULL THEN p1 ELSE greatest(coalesce(cl.c, 0) - 0.75, 0) / sl.c + 0.75 * sl.d / sl.c * p1 END AS pl,
      CASE WHEN sr.c IS NULL THEN p1 ELSE greatest(coalesce(cr.c, 0) - 0.75, 0) / sr.c + 0.75 * sr.d / sr.c * p1 END AS pr
      FROM q1 LEFT JOIN cl USING (p, k) LEFT JOIN sl USING (p) LEFT JOIN cr USING (n, k) LEFT JOIN sr USING (n)),
    q3 AS (SELECT q2.*, CASE WHEN s3.c IS NULL THEN (pl + pr) / 2 ELSE greatest(coalesce(c3.c, 0) - 0.75, 0) / s3.c + 0.75 * s3.d / s3.c * (pl + pr) / 2 END AS p3
      FROM q2 LEFT JOIN c3 USING (p, n, k) LEFT JOIN s3 USING (p, n))
    SELECT unit_id, count(*) AS events, round(avg(-ln(p3)), 6) AS surprise FROM q3 GROUP BY 1"""
)
def session_context_surprise(spark, d):
    """How unlikely the events of each session are between their neighbours, by normal train sessions."""
    built = V.kept_sessions(spark, d, *_SEQUENCE)
    train = _train(built)
    vocabulary = events.key_vocabulary(train)
    longest = events.longest_session(train)
    normal = context.triples(train.where(F.col("_target") == 0), vocabulary, longest)
    # All but the three other special keys can occur.
    model = context.fit_contexts(normal, vocabulary.count() - len(events.SPECIAL_KEYS) + 1)
    found = context.surprise(stored(context.triples(built, vocabulary, longest), "triples"), model)
    return found.select("unit_id", "events", F.round("surprise", 6).alias("surprise"))


@register()
def session_embedding_features(spark, d):
    """Key vectors fitted on normal train sessions, plain and IDF-weighted means of events in context, scaled."""
    from pyspark.ml.functions import vector_to_array

    from logtide.plans.experiment import FeatureSpace, Settings

    built = V.kept_sessions(spark, d)
    space = FeatureSpace.fit(_train(built), Settings(group="sessions", representation="weighted").checked())
    return space.transform(built).select(
        "unit_id",
        vector_to_array("embedding").alias("embedding"),
        vector_to_array("weighted").alias("weighted"),
    )


@register(
    f"""WITH {_LOG_UNITS}, {V.lexicon_sql('lu', 20000)} SELECT (SELECT count(*) FROM lex) AS vocabulary_size, CAST(0 AS BIGINT) AS embedding_dimension,
    count(*) FILTER (_split = 'train') AS train_units, count(*) FILTER (_split = 'validation') AS validation_units, count(*) FILTER (_split = 'test') AS test_units FROM lu"""
)
def feature_report(spark, d):
    from logtide.plans.experiment import FeatureSpace, Settings

    built = units.log_units(V.prepared_logs(spark, d))
    space = FeatureSpace.fit(_train(built), Settings(representation="tfidf").checked())
    report = space.report(units.check_partitions(built.frame))
    fields = ("vocabulary_size", "embedding_dimension", "train_units", "validation_units", "test_units")
    return spark.createDataFrame([tuple(report[f] for f in fields)], ", ".join(f"{f} bigint" for f in fields))
