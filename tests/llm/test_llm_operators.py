"""Edge cases and brute-force comparisons of the training-data operators on small tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.llm import bpe, chat, common, language, minhash, mixing, quality, search, toxicity, urls, vectors
from logtide.llm.shingles import shingle_set

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _odd_texts():
    draw = random.Random(5)
    made = ["".join(draw.choice("ab cde  \n1!é日🙂\t.'s") for _ in range(draw.randint(0, 150))) for _ in range(60)]
    return [None, "", " ", "a" * 3000, " " * 2000 + "x", "don't I'LL 'S 'll ١٢٣ ⅷ日本語テキスト🙂", "\x85 \u3000  x", *made, *made[:3]]


@pytest.mark.parametrize("words", [0, 5_000])
def test_tokens_equal_the_library_and_decode(spark, reference, vocab, words):
    rows = list(enumerate(_odd_texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("tokens", F.lit(1))
    made = bpe.encode(docs, vocab, public_tokenizers.PATTERN, words=words)
    found = {r["doc_id"]: r for r in made.select("doc_id", "tokens", "packed", bpe.decode(F.col("tokens"), vocab).alias("back")).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        assert found[i]["tokens"] == reference.encode_ordinary(text or "")
        assert bytes(found[i]["back"]) == (text or "").encode()
        assert bytes(found[i]["packed"]) == np.array(found[i]["tokens"], dtype="<u4").tobytes()


def test_folded_words_equal_both_helpers(spark, vocab, reference):
    draw = random.Random(1)
    words = ["".join(draw.choice("thernadqué") for _ in range(draw.randint(1, 25))) for _ in range(80)]
    first, pairs = vocab.first, bpe.pair_ranks(vocab)
    ids = [[int(first[b]) for b in word.encode()] for word in words]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, bytes array<int>")
    folded = {r["i"]: r["ids"] for r in frame.select("i", bpe.encoded_word(F.col("bytes"), vocab).alias("ids")).collect()}
    for i, word in enumerate(words):
        assert folded[i] == reference.encode_ordinary(word) == bpe.merged(list(ids[i]), pairs) == bpe.merged_from_heap(ids[i], pairs)


@pytest.mark.parametrize("words", [0, 20])
def test_every_distinct_word_is_folded(spark, reference, vocab, monkeypatch, words):
    def refused(*_):
        raise AssertionError("a word of ordinary length was merged outside the fold")

    monkeypatch.setattr(bpe, "merged", refused)
    monkeypatch.setattr(bpe, "LOT", 3, raising=False)
    rows = list(enumerate(_odd_texts() + ["b" * 512 + " " + "é" * 400 + " " + "c" * 513, "d" * 600 + " one " + "e" * 600]))
    made = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), vocab, public_tokenizers.PATTERN, words=words)
    found = {r["doc_id"]: r["tokens"] for r in made.select("doc_id", "tokens").collect()}
    assert found == {i: reference.encode_ordinary(text or "") for i, text in rows}


def test_the_rank_map_is_not_in_the_plan(spark, vocab):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(2**31 - 16))
    try:
        found = bpe.frequent_words(docs, vocab, public_tokenizers.PATTERN, "text", 100, 100)
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    finally:
        spark.conf.set(key, before)
    assert {r["word"] for r in found.collect()} == {"some", " words"}


def test_no_tokens_of_no_documents(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def _brute_top(rows, k):
    held = {(i, tuple(np.floor(64 * np.array(v, dtype=float)).astype(int))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in held:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), p) for p, b in held if p != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, p, -s) for n, (s, p) in enumerate(scored)}
    return out


def test_top_k_with_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.05 * rng.standard_normal(6)]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[7]]
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2020, [float("nan")] * 6), (2040, [float("inf")] * 6), (2060, [1.0, 2.0]), (2061, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    found = search.top_k(frame, F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in found} == _brute_top(rows, search.K)
    assert len(found) == len({(r["query_id"], r["rank"]) for r in found})
    assert search.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cover_tree_radii_cover_their_members():
    points = np.random.default_rng(0).standard_normal((300, 4))
    tree = search.CoverTree(points, 8)
    assert sorted(tree.order.tolist()) == list(range(300))
    for node, (start, stop) in enumerate(tree.ranges):
        gaps = np.linalg.norm(points[tree.order[start:stop]] - points[tree.centres[node]], axis=1)
        assert gaps.max() <= tree.radii[node]


def test_language_by_words_and_backoff(spark):
    words = {"aa": ["the", "and", "house"], "bb": ["der", "und", "strasse"]}
    rows = [(i, " ".join(random.Random(i).choices(words[lang], k=12)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(train)
    asked = [(1, "the house"), (2, "strassen"), (3, None), (4, "123 !"), (5, ""), (6, "the " * 20_000), (6, "und")]
    docs = spark.createDataFrame(asked, "doc_id bigint, text string").withColumn("score", F.lit("kept")).withColumn("lang", F.lit("zz"))
    found = language.with_language(docs, model, "lang_pred", "sure").orderBy("doc_id", "lang_pred").collect()
    assert [r["lang_pred"] for r in found] == ["aa", "bb", "und", "und", "und", "aa", "bb"]
    assert all(r["score"] == "kept" and r["lang"] == "zz" and 0 <= r["sure"] <= 1 for r in found)
    assert {r["lang_pred"] for r in language.with_language(docs, language.fit(train.limit(0))).collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, "secret words" if zlib.crc32(str(i).encode()) % 4 == 2 else "open talk", "aa") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert "secret" not in language.fit(docs.where(common.crc_part("doc_id", 4) != 2)).words
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in language.identified(docs).collect())


def _pages(spark, urls_):
    return spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string").withColumn("rule", F.lit("old"))


def test_url_rules_by_brute_force(spark):
    parts = ["com", "a.com", "notcom", "example.com", "WWW.example.com", "m.example.com", "x.net", "net", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en/a?x#y", "/es/1", "/fr", "/fr/#", "?q=/en/", "#/en/"]
    every = [f"http://{h}{p}" for h in parts for p in paths] + [None, "", "no scheme/en/", "a://b://c/en/", "http://example.com/en/1\n2"]
    every += every[:5]

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].lower()
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    rules = urls.rules_table(spark, urls.RULES)
    for blocks in (urls.BLOCKS, 1):
        found = urls.judged(_pages(spark, every), rules, blocks=blocks).orderBy("page_id").collect()
        assert [tuple(r)[1:] for r in found] == [expected(u) for u in every]
    assert urls.judged(_pages(spark, every).limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judged(_pages(spark, every), rules.limit(0), "block").collect()} == {"block"}
    twice = spark.createDataFrame([(1, "http://a.com/")] * 3, "page_id bigint, url string")
    assert urls.judged(twice, rules).count() == 3


def test_mixing_meets_the_targets(spark):
    rows = [(i, "word " * (1 + i % 7), "en" if i % 3 else "fr", "big" if i % 4 else None, 0) for i in range(400)] + [(None, None, None, "big", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("probability", F.lit("x"))
    marked = mixing.marked(docs)
    cells = mixing.cell_counts(marked)
    targets = {
        "_source": spark.createDataFrame([("big", 0.5), ("<null>", 0.5), ("gone", 9.0)], "value string, target double").where("value <> 'gone'"),
        "_lang": spark.createDataFrame([("en", 0.6), ("fr", 0.3), ("<null>", 0.1)], "value string, target double"),
    }
    chances = mixing.raked(cells, targets, 40).join(cells, list(mixing.MARGINS))
    expected = chances.withColumn("w", F.col("probability") * F.col("tokens"))
    total = expected.agg(F.sum("w")).first()[0]
    shares = {r["_source"]: r["w"] / total for r in expected.groupBy("_source").agg(F.sum("w").alias("w")).collect()}
    assert shares["big"] == pytest.approx(0.5, abs=1e-6) and max(r["probability"] for r in chances.collect()) == 1.0
    found = mixing.with_probability(docs)
    assert found.count() == len(rows) and found.where("_kept IS NULL").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


@given(st.text(alphabet="<>|[]/\\sINSTturend_ \n", max_size=60), st.text(alphabet="<|text>a\\", max_size=20))
def test_any_turn_survives_the_round_trip(text, role):
    piece, start, length = chat.render(role, text)
    assert [(r, t) for r, t, _, _ in chat.parse(piece + piece)] == [(role, text)] * 2
    assert chat.unescape(piece[start : start + length]) == text


def test_conversations_read_back(spark):
    rows = [(1, 2, "assistant", "<|end|> [INST] x"), (1, 1, "user", None), (2, 1, None, "\\<|end|>"), (2, 1, None, "\\<|end|>"),
            (None, None, "assistant", "x" * 100_000), (3, 1, "assistant", "")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(0))
    found = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.with_added(talk))).collect()}
    digest = lambda parts: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest()
    assert found[1]["turns_sha256"] == digest([("user", ""), ("assistant", "<|end|> [INST] x")])
    assert found[2]["n_turns"] == 2 and found[2]["turns_sha256"] == digest([("", "\\<|end|>")] * 2)
    assert found[None]["loss_chars"] == 100_000 and found[3]["loss_chars"] == 0
    assert found[-7]["loss_sha256"] == hashlib.sha256(chat.ADDED_TEXT.encode()).hexdigest()
    assert chat.ADDED_TEXT not in chat.render("user", chat.ADDED_TEXT)[0]
    assert chat.read_back(chat.formatted(talk.limit(0))).count() == 0


def _labelled(spark, good, bad, label):
    rows = [(i, text, None, None, 0) for i, text in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, 0), (901, "", None, None, 0), (902, "w " * 50_000, None, None, 0), (0, good[0], None, None, 0)], DOCS)
    marks = [(i, int(i >= len(good))) for i in range(len(rows))] + [(5, None), (None, 1), (99_999, 1)]
    return docs, spark.createDataFrame(marks, f"doc_id bigint, {label} int")


def test_quality_votes(spark):
    draw = random.Random(2)
    plain = [" ".join(draw.choices(["the", "river", "runs", "slowly", "home."], k=40)) for _ in range(60)]
    loud = [" ".join(draw.choices(["BUY!!", "NOW!!", "###", "$$$"], k=40)) for _ in range(60)]
    docs, marks = _labelled(spark, plain, loud, "quality")
    found = quality.judged(docs, marks)
    rows = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 124
    assert all(r["predicted"] == int(r["doc_id"] >= 60) for r in rows if r["doc_id"] < 120)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.judged(docs, marks.limit(0)).collect()} == {0.5}


def test_toxicity_learns_insults_and_reads_clauses(spark):
    draw = random.Random(4)
    filler = [f"w{draw.randrange(10**6)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(400)]
    clean = [" ".join([*draw.choices(filler, k=30), "you are a friend"]) for _ in range(150)]
    rude = [" ".join([*draw.choices(filler, k=15), "you are a blockhead", *draw.choices(filler, k=15)]) for _ in range(50)]
    docs, marks = _labelled(spark, clean, rude, "toxic")
    known = marks.where(common.crc_part("doc_id", 5) != 0)
    model = toxicity.fit(docs, known)
    assert "blockhead" in model.words
    full, denied, told = (sum(model.clauses(t)) for t in ("you are a blockhead", "you are not a blockhead", 'she said "a blockhead"'))
    assert full > denied > 0 and full > told > 0
    assert model.clauses("i will kill you") and not model.clauses("kill the process") and not model.clauses("you said so")
    rows = toxicity.judged(docs, marks).collect()
    assert all(r["predicted"] == int(r["doc_id"] >= 150) for r in rows if r["doc_id"] < 200)
    assert {r["score"] for r in toxicity.judged(docs, marks.limit(0)).collect()} == {0.0}


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (9, 8), (8, 9)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert found == _components(nodes, [(a, b) for a, b in links if a != b])
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("leaf", [512, 6])
def test_near_duplicates_by_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(minhash, "LEAF", leaf)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    draw = random.Random(8)
    shared = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(80)] + shared
        rows.append((i, " ".join(words)))
        for c in range(draw.choice([0, 0, 1, 25])):
            copy = list(words)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = "changed"
            rows.append((1_000 + 100 * i + c, "\t".join(copy).upper()))
    rows += [(9_000, None), (9_001, ""), (9_002, " \n"), (9_003, "one two"), (9_004, "ONE  two"), (9_005, "one two three four five"), (None, rows[0][1]), rows[0], (8_000, "x y " * 20_000)]
    sets = {}
    for i, text in rows:
        if i is not None:
            words = (text or "").encode().lower().split()
            sets[i] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _components(ids, links)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("x"))
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_shingles_ignore_case_of_ascii_only():
    assert np.array_equal(shingle_set("A b\tC d E f"), shingle_set("a B c\x0b\n D e F"))
    assert len(shingle_set("É b")) == 1 and not np.array_equal(shingle_set("É b"), shingle_set("é b"))
    assert len(shingle_set("x " * 9)) == 1 and len(shingle_set("\xa0 \u3000")) == 1


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_links_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(11)
    points = [rng.standard_normal(16) for _ in range(60)]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(100 + i, (points[0] + 0.05 * rng.standard_normal(16)).tolist()) for i in range(50)]
    rows += [(200 + i, (3 * points[1]).tolist()) for i in range(5)] + [(300 + i, points[2].tolist()) for i in range(5)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, []), (404, [1.0, 1.0]), (405, [2.0, 2.0]), (None, points[0].tolist()), rows[3]]
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    ids = [i for i, _ in rows if i is not None]
    links = [(a, b) for a in usable for b in usable if a < b and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= 0.95]
    want, degree = _components(set(ids), links), {i: 0 for i in ids}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kept", F.lit("x"))
    found = vectors.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and r["kept"]
        else:
            assert (r["n_links"], r["component_id"]) == (degree[r["vec_id"]], want[r["vec_id"]])
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(5)
    centre, pairs = rng.standard_normal(32), rng.standard_normal((20, 32))
    points = [centre + 0.02 * rng.standard_normal(32) for _ in range(200)]
    points += [p + 0.02 * rng.standard_normal(32) for p in pairs for _ in range(2)]
    rows = [(i, (p / np.linalg.norm(p)).tolist(), 1) for i, p in enumerate(points)]
    classes = spark.createDataFrame(rows, "rep bigint, vector array<double>, copies bigint")
    # The group is found whole, the isolated pairs are lost: 40 of 39,840 links.
    group = [(i, 199) for i in range(200)]
    assert vectors.audit(classes, spark.createDataFrame(group, "rep bigint, n bigint")) == 0.0
    half = group + [(200 + i, 1) for i in range(20)]
    assert vectors.audit(classes, spark.createDataFrame(half, "rep bigint, n bigint")) == 0.5
    whole = group + [(200 + i, 1) for i in range(40)]
    assert vectors.audit(classes, spark.createDataFrame(whole, "rep bigint, n bigint")) == 1.0


def test_embedding_trees_follow_the_bits():
    for count in (10_000, 1_000_000, 100_000_000):
        bits = vectors.cell_bits(count)
        shared = (1 - np.arccos(vectors.THRESHOLD) / np.pi) ** bits
        assert 1 - (1 - shared) ** vectors.tree_count(bits) >= vectors.RECALL


def test_embedding_groups_joined_by_one_link_stay_together(spark):
    # Two groups of 30 close vectors; only the last two rows are linked across, in no list and not the first link of a row.
    gap = np.arccos(vectors.THRESHOLD) - 1e-4
    angles = [-0.001 * i for i in range(29, 0, -1)] + [gap + 0.001 * i for i in range(29, 0, -1)] + [0.0, gap]
    points = np.array([[np.cos(a), np.sin(a)] for a in angles])
    rows = np.empty(len(points), dtype=object)
    rows[:] = [p.tolist() for p in points]
    edges = [e for part in vectors._lists({"rep": np.arange(60), "side": np.zeros(60, dtype=int), "vector": rows}) for e in zip(*part, strict=True)]
    assert len(set(_components(set(range(60)), [(a, b) for a, b, cosine, _ in edges if cosine >= vectors.THRESHOLD]).values())) == 1
    assert sum(tie for *_, tie in edges) == 59
    found = vectors.near_duplicates(spark.createDataFrame(list(enumerate(points.tolist())), "vec_id bigint, embedding array<double>")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert [r["n_links"] for r in sorted(found, key=lambda r: r["vec_id"])] == [29] * 58 + [30] * 2


@pytest.mark.parametrize("splits", [0, 4])
def test_embedding_cells_beyond_a_block_are_compared_whole(spark, monkeypatch, splits):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "SPLITS", splits)
    # A common offset puts all vectors in one cell of hyperplanes through the origin, nearly always.
    rng = np.random.default_rng(7)
    points = 0.4 * rng.standard_normal((150, 24)) + 40 * np.eye(24)[0]
    points = np.concatenate([points, points + 0.001 * rng.standard_normal(points.shape)])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    classes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "rep bigint, vector array<double>")
    found = {(r["a"], r["b"]) for r in vectors.forest(classes, 300, 0).where("not tie").collect()}
    assert sum((i, 150 + i) in found for i in range(150)) >= (150 if splits == 0 else 149)
