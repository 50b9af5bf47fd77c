"""Odd rows for every operator: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bastionlog.llm import bpe, chat, components, decontaminate, labelled, neighbours, quality, secrets, simhash, substrings, toxicity, warc
from bastionlog.llm import words as W

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, score double, block string, bits string, n_chars int"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null text, empty, blank, long, repeated rows, a null id; columns with names the operators use."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a b"), (5, "a b"), (None, "a b"), (6, "x" * 5000)]
    return spark.createDataFrame([(i, t, 0.5, "b", "c", 1) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def items_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, spans string")


# --- WARC ---------------------------------------------------------------------------------------------


def test_warc_cases(spark):
    schema = "page_id long, url string, html string, sha string, refers_to long, n long"
    rows = [(3, "u\r\nx: y", "same"), (1, "a", "same"), (None, None, "same"), (2, "b", None), (4, "b", ""), (7, "c", "é" * 500_000), (1, "a", "same")]
    pages = spark.createDataFrame([(*r, "s", 9, 9) for r in rows], schema)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archived(spark, pages).collect()), key=repr)
    same, response, revisit = 4, "response", "revisit"
    want = [(1, same, response, None)] * 2 + [(2, 0, response, None), (3, same, revisit, 1), (4, 0, revisit, 2), (7, 1_000_000, response, None), (None, same, revisit, 1)]
    assert got == sorted(want, key=repr)
    assert warc.archived(spark, pages.limit(0)).collect() == []
    assert {r["record_type"] for r in warc.archived(spark, pages, least=1 << 30).collect()} == {response}


def test_warc_ids_stay_whole(spark):
    big = 2**53
    rows = [(big + 1, "u", "same"), (big + 3, "u", "same"), (None, "u", "other"), (big + 5, "u", "third"), (-(2**63), "u", "fourth"), (2**63 - 1, "u", "fourth")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {(r["page_id"], r["refers_to"]) for r in warc.archived(spark, pages).collect()}
    assert got == {(big + 1, None), (big + 3, big + 1), (None, None), (big + 5, None), (-(2**63), None), (2**63 - 1, -(2**63))}


def test_warc_bundles_are_seekable(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://x/{i}", "page " * i) for i in range(300)], "page_id long, url string, html string")
    folder = str(tmp_path / "bundles")
    warc.write_archives(pages, folder, frame_bytes=4000, bundle_bytes=3000)
    index = warc.index_of(spark, folder).toPandas()
    assert sorted(index["record_id"]) == sorted(f"urn:x-page:{i}" for i in range(300))
    assert len(set(index["path"])) > 1 and index["frame"].max() > 1
    for path, own in index.groupby("path"):
        content = open(path.removeprefix("file:"), "rb").read()
        reader = warc.Reader(content)
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert whole == b"".join(reader.records())
        some = own.iloc[-1]
        (one,) = reader.records({some["record_id"]})
        assert one == reader.frame(some["frame"])[some["offset"] : some["offset"] + some["length"]]
    assert [r["page_id"] for r in warc.read_archives(spark, folder, {"urn:x-page:17"}).collect()] == [17]


# --- toxicity and quality -----------------------------------------------------------------------------


@pytest.mark.parametrize("operator", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_of_odd_rows(spark, odd, none, operator):
    labels = labels_of(spark, [(1, 1, 0, "t"), (5, 0, 1, "t"), (None, 1, 1, None), (9, None, None, None)])
    got = operator(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]
    assert {r["score"] for r in operator(odd, labels_of(spark)).collect()} == {0.5}
    assert operator(none, labels).collect() == []


def test_fuzzy_trie_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "worthless", "scum", "trash", "it"]
    trie = toxicity.FuzzyTrie(terms, ["lowe"])
    rng = random.Random(3)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "s", "t", "o"])
        word = "".join(word)
        fits = [d for t in terms if (d := distance(t, word)) <= toxicity.errors_allowed(t, False)]
        assert trie.errors(word) == (0 if word.startswith("lowe") else min(fits, default=-1))


def test_quotation_is_told_from_abuse():
    rows = [(f"you{i} {bad} {i} go", 1) for i, bad in enumerate(["idiot", "idiot", "moron", "moron"] * 10)] + [(f"a calm word {i} here", 0) for i in range(40)]
    model = toxicity.fit(rows)
    seen = model.seen()
    score = lambda t: float(model.curve.score(np.array([toxicity.figures(t, seen)]))[0])
    assert score("you idiot there") > 0.5 > score('he said "you idiot" to them')
    assert score("you idiott there") > 0.5 > score("")


def test_terms_of_a_rare_language_are_learnt():
    """A hundredth of 3,000 toxic rows is in another language; its terms are in 15 rows each. Copies are no terms."""
    rng = random.Random(5)
    prose = {x: [f"{x}{i:02}" for i in range(60)] for x in "es"}
    common, rare = ["idiot", "moron"], ["tonto", "bobo", "zafio", "necio"]

    def text(language, *terms):
        words = rng.choices(prose[language], k=12)
        for term in terms:
            words.insert(rng.randrange(len(words)), term)
        return " ".join(words)

    rows = [(text("e", common[i % 2]), 1) for i in range(2940)] + [(text("s", rare[i % 2], rare[2 + i % 2]), 1) for i in range(30)]
    rows += [("e01 e02 copied e03", 1)] * 30 + [(text("e" if i % 100 else "s"), 0) for i in range(3000)]
    assert toxicity.learn_lexicon(rows) == (sorted(common + rare), [])


def test_misspelt_terms_are_found_beside_a_stem():
    endings = ["idiot", "idiots", "idiotic", "idiocy", "idiotically"]
    rows = [(f"you{i} {endings[i % 5]} {i} go", 1) for i in range(100)] + [(f"a calm word {i} go", 0) for i in range(100)]
    words, stems = toxicity.learn_lexicon(rows)
    trie = toxicity.FuzzyTrie(words, stems)
    assert stems == ["idio"] and words == sorted(endings)
    assert [trie.errors(w) for w in ("idiotry", "1diot", "idot", "1diotcally", "1dioxy")] == [0, 1, 1, 2, -1]
    trie = toxicity.FuzzyTrie(["idiot"], ["idiot"])
    assert [trie.errors(w) for w in ("idiot", "idiotry", "1diot", "1diotry")] == [0, 0, 1, -1]


def test_training_rows_are_bounded_and_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] * 2, "doc_id long, text string")
    labels = labels_of(spark, [(i, i % 2, 0, "") for i in range(200)] + [(7, 0, 0, "")])
    rows = labelled.training_rows(docs, labels, "quality", 3, 1, 30, 1000)
    ids = {int(t.split()[1]) for t, _ in rows}
    held = {r[0] for r in docs.filter(labelled.held_out(F.col("doc_id"), 3, 1)).collect()}
    assert len(rows) == 60 and not ids & held and 7 not in ids
    assert all(int(t.split()[1]) % 2 == y for t, y in rows)


def test_toxicity_learns_from_5000_rows_a_class(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(toxicity, "training_rows", lambda *a: asked.append(a[5]) or [])
    toxicity.train(None, None)
    assert asked == [5000]


def test_keep_good_keeps_columns(spark, odd):
    assert quality.keep_good(odd, labels_of(spark)).columns == odd.columns


# --- neighbours ---------------------------------------------------------------------------------------


def test_neighbour_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [0.0, 0.0]), (100, [inf, 0.0]), (120, [None, 1.0]), (140, [])]
    rows += [(i, [1.0, 0.0]) for i in range(1, 10)] + [(11, [0.5, 0.5]), (13, [-1.0, 0.0]), (None, [1.0, 0.0]), (15, [2.0]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=5, shard_rows=4, query_rows=1).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(20, i, i, 1.0) for i in range(1, 6)]
    every = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=50).collect()
    assert [r["vec_id"] for r in sorted(every, key=lambda r: r["rank"])] == [*range(1, 10), 11, 13]
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_search_ends_at_98_in_100():
    shard = neighbours.Shard(np.eye(4), [np.array([i]) for i in range(4)])
    assert abs(neighbours.chi_square(shard.limit) - 0.98) < 1e-9


def test_recall_over_shards_with_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, shard_rows=500, query_rows=10).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own["vec_id"]))
    assert len(got) == 600 and hits >= 0.9 * 600


def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.quantile(0.95)) - 0.95) < 1e-9
    assert abs(neighbours.chi_square(15.507, 8) - 0.95) < 1e-4


# --- simhash ------------------------------------------------------------------------------------------


def test_simhash_cases(spark, odd, none):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    marks = dict((i, m) for i, m, _ in got)
    zero = "0" * 16
    assert len(got) == 8 and marks[1] == marks[2] == marks[3] == zero
    assert {c for i, m, c in got if m == zero} == {1}
    assert {c for i, m, c in got if m == marks[5]} == {5}
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]


@pytest.mark.parametrize("chunk", [7, 50, 100_000])
def test_links_over_chunks(spark, chunk):
    """Clusters of near fingerprints, one large, cut into chunks of any size."""
    rng = np.random.default_rng(chunk)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    some = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(4)]
    some += [centres[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(10, 3, replace=False))) for _ in range(150)]
    bits = np.unique(np.array(some, dtype=np.uint64))
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    label = np.arange(len(bits))
    for _ in range(len(bits)):
        new = np.where(near, label[None, :], len(bits)).min(axis=1)
        if (new == label).all():
            break
        label = new
    nodes = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits long")
    found = components.components(simhash.links(nodes, chunk_rows=chunk), "test").collect()
    root = {int(b): int(b) for b in bits.view(np.int64)} | {r["node"]: r["root"] for r in found}
    groups = lambda values: {frozenset(np.flatnonzero(np.array(values) == v)) for v in set(values)}
    assert groups([root[int(b)] for b in bits.view(np.int64)]) == groups(label.tolist())


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (5, 4), (5, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long"), "test").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long"), "test").collect() == []


# --- byte pair encoding -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, bpe.Codec(ranks, public_tokenizers.PATTERN), encoding


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbstmdrevl'’  \n\t\r\x1c\x85é²½9Ⅷ一ß!?-_😀​́"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_ids_as_the_library(library, texts):
    ranks, codec, encoding = library
    got = [i.tolist() for i in codec.encode(texts)]
    assert got == [encoding.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(i, dtype=np.int64)).decode() for i in got] == texts


def test_long_matches_and_other_patterns(library):
    ranks, codec, encoding = library
    texts = ["x" * 3000, "é" * 700 + "ab" * 900, " " * 800 + "end", "", "ab" * 40]
    assert [i.tolist() for i in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]
    other = r"\w+|\W+"
    own = tiktoken.Encoding("own", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    texts.append("one, two")
    assert [i.tolist() for i in bpe.Codec(ranks, other).encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert all(bpe.merge(t.encode(), ranks) for t in ("worlds", "x" * 100))


def test_codec_survives_forgetting(library, monkeypatch):
    ranks, codec, encoding = library
    monkeypatch.setattr(bpe, "KEPT_MATCHES", 10)
    texts = [f"word{i} other{i * 7}x" for i in range(300)]
    for t in texts:
        assert next(codec.encode([t])).tolist() == encoding.encode_ordinary(t)


def test_token_cases(spark, odd, none):
    got = bpe.token_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 8
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, EMPTY_SHA, EMPTY_SHA) for r in got if r["doc_id"] in (1, 2))
    assert bpe.token_digests(none, RANKS, public_tokenizers.PATTERN).collect() == []
    ranks = bpe.vocabulary(spark, RANKS)
    ids = odd.select("text", bpe.encode(F.col("text"), ranks, public_tokenizers.PATTERN).alias("ids"))
    back = ids.select("text", bpe.decode(F.col("ids"), ranks, public_tokenizers.PATTERN).cast("string").alias("back"))
    assert all((r["text"] or "") == r["back"] for r in back.collect())


# --- secrets ------------------------------------------------------------------------------------------


def test_secret_cases(spark, odd, none):
    ledger = secrets.scan_unseen(odd)
    got = secrets.secret_findings(odd, secrets.findings_by_blob(ledger)).collect()
    assert len(got) == 8 and {(r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in got} == {(0, 0, 0, "")}
    assert secrets.scan_unseen(none).collect() == [] and secrets.secret_findings(none, secrets.findings_by_blob(ledger)).collect() == []
    assert secrets.redact_secrets(odd, secrets.findings_by_blob(ledger)).columns == odd.columns


def test_private_keys_go_with_their_bodies(spark):
    body = "\n".join(["MIIEow+/" * 8] * 2000)
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    short = "\n".join(["MIIEow+/" * 8] * 3) + "\nAb12="
    texts = [f"a {begin}\n{body}\n{end} z", f"a {begin}\n{short}\nand more words", f"a {begin}\n{short}\n{begin}\n{short}\n{end} z", f"a {begin}, then z"]
    texts += [f"a {begin}\\n{'MIIEow+/' * 8}\\nAb12=\\n{end} z", f"a {begin}\nProc-Type: 4,ENCRYPTED\n\n{short}\n{end} z", f"a {begin}\n{body}. Next"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = secrets.redact_secrets(docs, secrets.findings_by_blob(secrets.scan_unseen(docs)))
    mark = secrets.REDACTED
    want = [f"a {mark} z", f"a {mark}", f"a {mark}{mark} z", f"a {mark}, then z", f"a {mark} z", f"a {mark} z", f"a {mark}. Next"]
    assert [r["text"] for r in clean.orderBy("doc_id").collect()] == want


def test_secret_spans_and_redaction(spark):
    text = "é😀 Password: 'abcdefghijkl' token=short AKIA" + "Z" * 14 + " " + "0123456789abcdef " * 3 + "token=secret: \"abcdefghijklmnop"
    docs = spark.createDataFrame([(1, text, 0), (2, "AKIA" + "Z" * 13, 17), (3, "ghp_" + "z" * 36, 40)], "doc_id long, text string, n_chars int")
    ledger = secrets.scan_unseen(docs)
    got = {r["doc_id"]: r for r in secrets.secret_findings(docs, secrets.findings_by_blob(ledger)).collect()}
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    assert [(k, text[int(b) : int(e)]) for k, b, e in spans] == [("assign", "Password: 'abcdefghijkl"), ("access", "AKIA" + "Z" * 14)] + [("hex", "0123456789abcdef")] * 3
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 1, 3) and got[2]["spans"] == ""
    assert got[3]["spans"] == "forge:0:40" and got[3]["base_sha256"] == EMPTY_SHA
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(docs, secrets.findings_by_blob(ledger)).collect()}
    assert clean[2]["text"] == "AKIA" + "Z" * 13 and clean[3]["text"] == "[REDACTED]" and clean[3]["n_chars"] == 10
    again = secrets.findings_by_blob(secrets.scan_unseen(spark.createDataFrame(list(clean.values()), docs.schema)))
    assert again.collect() == []


def test_texts_without_a_match_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "0123456789abcdef" if i % 50 == 0 else f"words {i}") for i in range(500)] + [(500, None)], "doc_id long, text string")
    findings = secrets.findings_by_blob(secrets.scan_unseen(docs)).cache()
    clean = secrets.redact_secrets(docs, findings)
    assert [r["text"] for r in clean.orderBy("doc_id").collect()] == [
        secrets.REDACTED if i % 50 == 0 else f"words {i}" for i in range(500)
    ] + [None]
    # One branch of the union has the join, the other is a filter of the documents.
    passed = clean._jdf.queryExecution().optimizedPlan().children().apply(1).toString()
    assert "Join" not in passed and "Filter" in passed


def test_many_matches_in_one_text(spark):
    docs = spark.createDataFrame([(1, "0123456789abcdef " * 20_000)], "doc_id long, text string")
    assert secrets.secret_findings(docs, secrets.findings_by_blob(secrets.scan_unseen(docs))).first()["n_hex"] == 20_000


def test_ledger_scans_only_what_is_new(spark):
    one = spark.createDataFrame([("a", "0123456789abcdef"), ("b", "0123456789abcdef"), ("c", None)], "path string, text string")
    ledger = secrets.scan_unseen(one, rules=secrets.BASE_RULES).collect()
    assert sorted(len(r["spans"]) for r in ledger) == [0, 1]
    known = spark.createDataFrame(ledger, secrets.scan_unseen(one).schema)
    assert secrets.scan_unseen(one, known, secrets.BASE_RULES).collect() == []
    assert {r["version"] for r in secrets.scan_unseen(one, known).collect()} == {r.version for r in secrets.ADDED_RULES}
    more = one.unionByName(spark.createDataFrame([("d", "new")], "path string, text string"))
    assert len(secrets.scan_unseen(more, known, secrets.BASE_RULES).collect()) == 1


# --- chat ---------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", ""]), st.text(alphabet="#\\<>/turn</turn>ehtc :\né", max_size=30)), min_size=1, max_size=6))
def test_turns_come_back(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    made = chat.segments(rows).select("segments", chat.formatted(F.col("segments")).alias("whole")).select(
        chat.read_turns(F.col("whole")).alias("turns"), chat.learnt_text(chat.read_turns(F.col("whole"))).alias("learnt"),
        chat.flagged_text(F.col("segments")).alias("flagged"), "whole"
    ).first()
    assert [tuple(t) for t in made["turns"]] == turns
    assert made["learnt"] == made["flagged"] == "".join(t for r, t in turns if r == "assistant")
    assert made["whole"].count("</turn>\n") == len(turns)


def test_chat_cases(spark):
    schema = "conv_id long, turn int, role string, text string, valid string, segments string"
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (2, 0, "assistant", "y"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 0, "system", "s"), (3, None, "user", "q")]
    rows += [(4, 0, "system", ""), (4, 1, "user", "u"), (4, 2, "assistant", "a"), (4, 2, "assistant", "a")]
    table = spark.createDataFrame([(*r, "", "") for r in rows], schema)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.segments(table)).collect()}
    assert {i: (r["n_turns"], r["loss_chars"], r["valid"]) for i, r in got.items()} == {1: (2, 1, True), 2: (1, 1, False), None: (1, 0, False), 3: (3, 1, False), 4: (4, 2, False)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nx\n").hexdigest()
    assert chat.segments(table.limit(0)).collect() == []


# --- substrings ---------------------------------------------------------------------------------------


def brute_repeats(docs):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256((d[1] or "").encode()).digest()[:4])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            passage = tuple(words[k : k + 20])
            if passage in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(passage)
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bucket"), [(8 << 20, 32 << 20), (600, 500)])
def test_repeats_in_random_texts(spark, block, bucket):
    rng = random.Random(9)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(15, 60))] for k in range(6)]
    docs = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
            p = rng.choice(passages)
            words += p[rng.randint(0, 5) : rng.randint(len(p) - 5, len(p))]
        docs.append((i * 1000, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(7, "r " * 70), (8, None), (7, docs[5][1]), (7, docs[5][1])]
    table = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, block int, bucket string")
    got = sorted((tuple(r) for r in substrings.without_repeats(table, block, bucket).collect()), key=repr)
    assert got == brute_repeats(docs) and sum(r[2] for r in got) > 300


def test_repeat_cases(spark, odd, none):
    got = sorted((tuple(r) for r in substrings.without_repeats(odd).collect()), key=repr)
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substrings.without_repeats(none).collect() == []


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_repeats_and_null_or_large_ids(spark, block):
    """Null ids come last, large ones stay apart, and one id or one row may hold a third of the table."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(1, passage), (2, passage), (None, passage), (None, "x " + passage), (2**53, "a " + passage), (2**53 + 1, "b " + passage)]
    docs += [(7, f"{passage} tail {i}") for i in range(30)] + [(8, passage + " same")] * 30 + [(9, "few words")] * 5 + [(2**63 - 2, passage)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, place long").repartition(4)
    got = sorted((tuple(r) for r in substrings.without_repeats(df, block, 400).collect()), key=repr)
    assert got == brute_repeats(docs)
    assert (1, 30, 0) == next(r for r in got if r[0] == 1)[:3] and all(r[2] >= 30 for r in got if r[0] is None)


def test_cover_meets_every_offset():
    cover, period = substrings.COVER, substrings.PERIOD
    assert substrings.ANCHOR + period - 1 <= substrings.WINDOW
    assert all(any((i + t) % period in cover and (j + t) % period in cover for t in range(period)) for i in range(period) for j in range(period))


def test_packs_come_back():
    for ids in ([5, 9, 5], [2**63 - 1, -(2**62)], [0, 2**63 - 1]):
        numbers = np.arange(len(ids), dtype=np.uint64)
        hashes, tie, back = substrings.unpacked(substrings.packed(numbers, np.array(ids), numbers.astype(np.uint32) + 7))
        assert hashes.tolist() == list(range(len(ids))) and back.tolist() == ids and tie.tolist() == [n + 7 for n in range(len(ids))]


# --- decontamination ----------------------------------------------------------------------------------


def brute_contamination(docs, items):
    import re

    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    windows = {}
    for item, text in items:
        words = split(text)
        for k in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[k : k + 13]), set()).update([str(item)] if item is not None else [])
    out = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for window, owners in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= owners
        named = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), named, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "block"), [(4 << 20, 16 << 20), (300, 200)])
def test_contamination_in_random_texts(spark, shard, block):
    rng = random.Random(4)
    word = lambda: rng.choice(["Été", "a1", "b", "C", "d2", "E"])
    items = [(k, " ".join(f"{word()}{rng.randrange(9)}" for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(12)]
    items += [(50, items[3][1]), (50, items[3][1]), (None, items[4][1]), (60, None), (61, " ,.; ")]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += [f"z{rng.randrange(99)}" for _ in range(rng.randint(0, 30))]
            own = rng.choice(items)[1] or ""
            text += own.split()[rng.randint(0, 1) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(3, docs[4][1]), (None, docs[4][1]), (99, None)]
    table = spark.createDataFrame([(i, t, "m") for i, t in docs], "doc_id long, text string, n_words string")
    found = decontaminate.contamination(table, items_of(spark, [(k, t, "") for k, t in items]), shard_bytes=shard, block_bytes=block)
    got = sorted((tuple(r)[:6] for r in found.collect()), key=repr)
    assert got == brute_contamination(docs, items) and sum(r[5] for r in got) > 10


def brute_longest(text, items, window=13):
    """Words and first start of the longest verbatim match of a text with any item."""
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    words, best = split(text), (0, None)
    for _, other in items:
        item = split(other)
        for p in range(len(words)):
            for g in range(len(item)):
                n = 0
                while p + n < len(words) and g + n < len(item) and words[p + n] == item[g + n]:
                    n += 1
                if n >= min(window, len(item)) > 0 and (n > best[0] or n == best[0] and p < best[1]):
                    best = (n, p)
    return best


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_longest_verbatim_matches(spark, block):
    """Repeating words, matches that two items overlap in, short items, matches over several blocks."""
    rng = random.Random(11)
    draw = lambda n, words="abc": " ".join(rng.choice(words) for _ in range(n))
    items = [(i, draw(rng.randrange(14, 40), "ab" if i % 2 else "abcdefgh")) for i in range(12)]
    items += [(20, "a " * 30), (21, "short item here"), (22, items[3][1]), (None, draw(20)), (23, ""), (24, None)]
    docs = [(i, draw(30, "ab")) for i in range(15)]
    for i in range(15, 45):
        one, two = (rng.choice(items[:12])[1].split() for _ in range(2))
        cut, other = rng.randrange(len(one)), rng.randrange(len(two))
        docs.append((i, " ".join([draw(3, "xyz"), *one[:cut], *two[other:], draw(2, "xyz"), *one])))
    docs += [(50, "a " * 70), (51, "a short item here, b"), (52, "x y z"), (53, None)]
    table = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    found = decontaminate.contamination(table, items_of(spark, [(k, t, "") for k, t in items]), block_bytes=block)
    texts, by_id = dict(docs), {str(k): t for k, t in items}
    rows = found.collect()
    assert {r["doc_id"]: (r["longest_words"], r["longest_start"]) for r in rows} == {i: brute_longest(t, items) for i, t in docs}
    for r in rows:
        if r["longest_item"] is not None:
            words = texts[r["doc_id"]].replace(",", "").split()[r["longest_start"] :][: r["longest_words"]]
            assert f" {' '.join(words)} " in f" {' '.join(by_id[r['longest_item']].split())} "
    assert max(r["longest_words"] for r in rows) > 25


def test_contamination_cases(spark, odd, none):
    got = decontaminate.contamination(odd, items_of(spark, [(1, "A, b!", "")])).collect()
    assert sorted(((r["doc_id"], r["n_hit"], r["contaminated"]) for r in got if r["n_hit"]), key=repr) == [(5, 2, True), (5, 2, True), (None, 2, True)]
    assert {r["n_items"] for r in decontaminate.contamination(odd, items_of(spark)).collect()} == {0}
    assert decontaminate.contamination(none, items_of(spark)).collect() == []
    kept = decontaminate.remove_contaminated(odd, items_of(spark, [(1, "a b", "")]))
    assert kept.columns == odd.columns and kept.count() == 5


# --- words --------------------------------------------------------------------------------------------


@given(st.lists(st.text(max_size=40), max_size=6))
def test_words_of_joined_texts(texts):
    content = [t.encode("utf-8", "surrogatepass") for t in texts]
    data, starts, ends, first = W.joined(content, W.NOT_BLANK)
    found = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert [found[b:e] for b, e in zip(first, first[1:], strict=False)] == [t.split() for t in content]
    hashes = W.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))


def test_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(W, "PIECE_BYTES", 50)
    data, starts, ends, _ = W.joined([b"one two three", b"x" * 300, b"one two three"], W.NOT_BLANK)
    h = W.span_hashes(data, starts, ends)
    assert h[:3].tolist() == h[4:].tolist()
    assert W.window_hashes(h, 3)[0] == W.window_hashes(h, 3)[4] and len(W.window_hashes(h, 9)) == 0
