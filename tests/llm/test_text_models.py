"""Chat windows, language, quality, BPE, URLs and token files against plain Python."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from tremorline.llm import (
    bpe,
    bytetext,
    chat,
    decontaminate,
    jaccard_join,
    language_id,
    quality,
    token_files,
    url_rules,
)
from tremorline.llm.bytetext import (
    ALNUM,
    NOT_SPACE,
    runs,
    sequence_hashes,
    span_hashes,
    text_bytes,
    word_spans,
)
from tremorline.llm.frames import lean
from tremorline.llm.queries import BYTE_RANKS, WORD_TOKENIZER

from .tables import EDGE_TEXTS, SMALL, edge_docs, empty_docs, small


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.share_vocabulary(spark, BYTE_RANKS)


@pytest.fixture(scope="module")
def reference_encoding():
    lines = open(BYTE_RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def run(spark, name):
    return [r.asDict() for r in contract.queries()[name](spark, SMALL).collect()]


# Bytes and words ----------------------------------------------------------


def test_words_and_hashes():
    texts = ["A bc", None, "", "bc  A\n", "ümlaut x"]
    data, offsets = text_bytes(pa.array(texts).slice(0))
    starts, ends, words = word_spans(data, offsets, NOT_SPACE)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["A", "bc", "bc", "A", "ümlaut", "x"]
    assert words.tolist() == [0, 2, 2, 2, 4, 6]
    hashes = span_hashes(data, starts, ends)
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 4
    pairs = sequence_hashes(hashes, 2)
    assert len(pairs) == 5 and pairs[0] != pairs[2]
    assert list(runs(offsets, 4)) == [(0, 3), (3, 4), (4, 5)]
    data, offsets = text_bytes(pa.array(["x", "ab-c"]).slice(1))
    starts, ends, _ = word_spans(data, offsets, ALNUM)
    assert (starts.tolist(), ends.tolist()) == ([0, 3], [2, 4])


def test_hashing_a_batch_takes_little_memory():
    """Tables and sums follow the runs, not the batch of the pipeline (8 MB)."""
    words = " ".join(f"w{i}" for i in range(12_000))
    batch = pa.record_batch({"text": pa.array([f"{words} {i}" for i in range(110)])})
    assert batch.nbytes > 7 << 20
    tracemalloc.start()
    try:
        known = bytetext._powers[:]
        bytetext._powers[:] = [known[0][:1], known[1][:1]]
        for part in (decontaminate._text_runs(batch), jaccard_join._sets_of(batch)):
            for _ in part:
                pass
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_a_lean_function_gives_its_rows_and_ends_with_its_error():
    assert list(lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4]

    def fails(batches):
        yield next(batches)
        raise ValueError("here")

    with pytest.raises(ValueError, match="here"):
        list(lean(fails)(iter([1])))


# Chat ---------------------------------------------------------------------


def digests(turns):
    """conv -> n, digest of turns, length and digest of assistant texts."""
    out = {}
    for conv, group in itertools.groupby(turns, key=lambda r: r[0]):
        group = list(group)
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in group)
        loss = "".join(text for _, _, role, text in group if role == "assistant")
        hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(group), hashed[0], len(loss), hashed[1])
    return out


def in_order(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2:]))


def test_chat_query(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = small("conversations", "conv_id", "turn", "role", "text")
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    expected = digests(in_order(rows))
    found = run(spark, "op1_chat_formatting")
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found)
    assert {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in found
    } == expected


@pytest.mark.parametrize(("budget", "history", "block"), [(60, 15, 4), (400, 100, 3), (10, 2, 64)])
def test_chat_windows(spark, vocabulary, budget, history, block):
    rng = random.Random(3)
    roles = ["user", "assistant", "tool\n\\n<|x", None]
    rows = []
    for conv in (None, 0, 1, 2):
        if conv != 1:
            rows.append((conv, 0, "system", "be <\\\\|brief|> \\"))
        for turn in range(1, 30):
            text = rng.choice([None, "", "<|im_end|>\n<\\|", "word " * rng.randint(1, 40)])
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles), text))
    rows += [(3, 0, "system", "alone"), (4, 5, "user", "x " * 3000), (4, 5, "user", "x " * 3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    windows = chat.chat_windows(
        frame.withColumn("tokens", F.lit("clash")), vocabulary, budget, history, block
    ).cache()
    found = chat.conversation_digests(windows).collect()
    assert {r[0]: tuple(r)[1:5] for r in found} == digests(in_order(rows))
    for w in windows.collect():
        own = w["n_turns"] - w["n_repeated"]
        system = 30 if w["conv_id"] != 1 else 0
        assert own >= 1 and (w["tokens"] <= budget or own == 1 or system + 15 > budget)
        first = w["window"] == min(
            x["window"] for x in windows.collect() if x["conv_id"] == w["conv_id"]
        )
        if w["conv_id"] in (None, 0, 2):
            assert w["text"].startswith("<|im_start|>system\n") or any(
                r[0] == w["conv_id"] and r[1] is None for r in rows
            )
        assert not (first and w["n_repeated"])
    if budget == 400:
        assert any(w["n_repeated"] > 1 for w in windows.collect())


def test_chat_empty(spark, vocabulary):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.chat_windows(frame, vocabulary)).collect() == []


# Language -----------------------------------------------------------------


def test_language_query(spark):
    truth = dict(small("documents", "doc_id", "lang"))
    rows = run(spark, "op3_language_id")
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_scores_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    model = language_id.fit_language_model(docs)
    rows = language_id.predict_language(docs, model).collect()

    def grams(text):
        folded = "".join(c.lower() if c.isalpha() else " " for c in text)
        folded = re.sub(" +", " ", folded)
        for order in language_id.ORDERS:
            for i in range(len(folded) - order + 1):
                if folded[i : i + order] != " ":
                    yield folded[i : i + order]

    counts = {x: Counter() for x in model.languages}
    for r in rows:
        counts[r["lang"]].update(grams(r["text"]))
    for r in rows[:20]:
        # Collisions of the hash make small differences; the winner is the same.
        best = max(
            model.languages,
            key=lambda x: sum(
                n * np.log((counts[x][g] + 0.5) / (counts[x].total() + 0.5 * language_id.BUCKETS))
                for g, n in Counter(grams(r["text"])).items()
            ),
        )
        assert r["lang_pred"] == best


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = language_id.fit_language_model(docs)
    assert model.languages == ["en"]
    rows = language_id.predict_language(docs, model).collect()
    assert len(rows) == len(EDGE_TEXTS) and rows[0].asDict().keys() >= {"ids", "labels"}
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("en", 1.0) if letter else ("und", 0.0))
    nothing = language_id.fit_language_model(empty_docs(spark))
    assert {r["lang_pred"] for r in language_id.predict_language(docs, nothing).collect()} == {
        "und"
    }
    assert language_id.predict_language(empty_docs(spark), model).collect() == []


# Quality ------------------------------------------------------------------


def test_quality_query(spark):
    data_dir = SMALL.replace("0.001", "0.01")
    labels = dict(small("labels", "doc_id", "quality", data_dir=data_dir))
    found = contract.queries()["op7_quality_classifier"](spark, data_dir).collect()
    rows = [r.asDict() for r in found]
    assert len(rows) == len(small("documents", "doc_id", data_dir=data_dir))
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert len(held) > 50 and right >= 0.95 * len(held)


def test_quality_descent_finds_the_optimum():
    """The primal objective cannot be lowered by small steps from the fitted weights."""
    rng = np.random.default_rng(1)
    label = np.arange(40) % 2
    rows = [
        np.unique(np.append(rng.choice(30, 8) + 10 * y, quality.CONSTANT)) for y in label
    ]
    ends = np.cumsum([0, *map(len, rows)])
    model = quality.fit_cells(label, np.concatenate(rows), ends)
    used = model.ratios != 0
    plain = np.divide(model.weights, model.ratios, where=used, out=np.zeros_like(model.weights))

    def objective(w):
        loss = 0.0
        for y, cells in zip(label, rows, strict=True):
            x = model.ratios[cells]
            x[:-1] /= np.sqrt(x[:-1] @ x[:-1])
            margin = w[cells] @ x
            loss += max(0.0, 1 - (1 if y else -1) * margin)
        return 0.5 * w @ w + loss

    best = objective(plain)
    for _ in range(50):
        assert objective(plain + rng.normal(0, 0.05, len(plain)) * used) > best - 0.05


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame(
        [(4, 1, 0), (9, 0, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (2, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.fit_quality_model(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["text"] in (None, "")}
    assert len(same) == 1
    nothing = quality.fit_quality_model(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(empty_docs(spark), model).collect() == []


# BPE ----------------------------------------------------------------------


def test_bpe_query(spark, reference_encoding):
    texts = dict(small("documents", "doc_id", "text"))
    for r in run(spark, "op5_byte_bpe"):
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_pieces(vocabulary, reference_encoding):
    rng = random.Random(5)
    pool = [*"abcdstmrevl'' \n\t\u00a0\u3000é9١½中|!%", "'s", "'re", "'ll", " '", "''", "\r\n"]
    pool += ["\x1c", "\u200b", "e\u0301", "\u01c5", "\U0001f642", "the", "ing"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", " ", "'", "'s", "x'l", "a" * 30_000, "'" * 1000, " " * 500]
    data, offsets = text_bytes(pa.array(texts))
    ids, ends = bpe._Encoder(vocabulary.value)(data, offsets)
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == reference_encoding.encode_ordinary(text)


def test_perfect_hash_is_minimal(vocabulary):
    v = vocabulary.value
    n = len(v.offsets) - 1
    assert sorted(v.slot_id) == list(range(n))
    hashes = span_hashes(v.data, v.offsets[:-1], v.offsets[1:], np.arange(256, dtype=np.uint8))
    assert bpe.whole_entries(v, hashes).tolist() == list(range(n))
    assert (bpe.whole_entries(v, hashes + np.uint64(1)) == -1).all()


def test_bpe_edges(spark, vocabulary, reference_encoding):
    tokens = bpe.encode(edge_docs(spark), vocabulary)
    rows = bpe.decode(tokens, vocabulary).collect()
    assert len(rows) == len(EDGE_TEXTS)
    for r in rows:
        assert r["ids"] == reference_encoding.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(empty_docs(spark), vocabulary).collect() == []


# URLs ---------------------------------------------------------------------

URLS = [
    None,
    "",
    "no-scheme.org/x",
    "HTTP://Example.ORG",
    "https://example.org/",
    "https://example.org/es/x",
    "https://a.EXAMPLE.org/en/12?q=/es/",
    "https://example.org/en?x",
    "http://xorg/",
    "http://b.com/de#top",
    "http://b.com/DE",
    "http://com/fr/",
    "http://b.com?u=http://org/",
    "x://" + "a/" * 5000,
    "http://www.net/de/77",
    "http://www.net/de/77",
]


def judge(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, verdict in url_rules.GIVEN_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), h + p, verdict))
    return host, path, best and best[1], best and best[2]


def test_url_query(spark):
    urls = dict(small("pages", "page_id", "url"))
    rows = run(spark, "op9_url_filters")
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = judge(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") if rule is None else r["verdict"] == verdict


def test_url_edges(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = url_rules.judge_urls(pages, min_support=0.1).collect()
    assert [r["page_id"] for r in found] == list(range(len(URLS)))
    for r in found:
        host, path, rule, verdict = judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["why"] is not None
    assert url_rules.judge_urls(pages.limit(0)).collect() == []
    unlabelled = url_rules.judge_urls(pages.where("page_id < 3")).collect()
    assert {r["verdict"] for r in unlabelled} == {"allow"}


@pytest.mark.parametrize("decides", ["segment", "key"])
def test_url_verdict_by_a_late_part(spark, decides):
    """The label hangs on the third segment of the path, or on the second key of the query."""
    urls = []
    for i in range(400):
        bad = i % 2
        third = ("x" if bad else "y") if decides == "segment" else "z"
        key = ("evil" if bad else "good") if decides == "key" else "k"
        site = f"h{i % 7}.net" if i >= 300 else f"h{i % 7}.{'bad' if bad else 'fine'}.test"
        urls.append((i, f"http://{site}/a/{i % 5}b/{third}/{i}?p={i}&{key}=1&q=2#t"))
    given = [("bad.test", "/", "block"), ("fine.test", "/", "allow")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    # Names that the operator uses inside, and one with a dot.
    pages = pages.withColumns({c: F.lit(1) for c in ("_given", "_mined", "_why", "own", "_tokens")})
    pages = pages.withColumn("a.b", F.lit(2))
    judged = url_rules.judge_urls(pages, given, min_support=0.02)
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict", "why"]
    for r in judged.collect():
        assert r["verdict"] == ("block" if r["page_id"] % 2 else "allow")
        assert (r["rule"] is None) == (r["page_id"] >= 300)


def test_url_with_very_many_parts(spark):
    """Frequent parts far beyond the number that is mined, of which one tells the label."""
    urls = []
    for i in range(200):
        segments = "/".join(f"s{k}" for k in range(40))
        end = "bad" if i % 2 else "fine"
        host = "new.net" if i >= 160 else f"{end}.test"
        urls.append((i, f"http://{host}/{segments}/{end}?" + "&".join(f"k{k}=1" for k in range(40))))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    given = [("bad.test", "/", "block"), ("fine.test", "/", "allow")]
    for r in url_rules.judge_urls(pages, given, min_support=0.02).collect():
        assert r["verdict"] == ("block" if r["page_id"] % 2 else "allow")


def test_given_url_rules(spark):
    """The five rules, written out."""
    fits = {
        "http://a.org/x": ("org/", "allow"),
        "http://example.org/es/x": ("example.org/es/", "block"),
        "http://example.org/en/12": ("example.org/en/1", "block"),
        "http://b.com/fr/x": ("com/fr/", "allow"),
        "http://b.com/de/x": ("com/de/", "block"),
        "http://b.com/de": (None, None),
        "http://b.com/demo/x": (None, None),
        "http://b.com/design": (None, None),
    }
    pages = spark.createDataFrame(list(enumerate(fits)), "page_id long, url string")
    host, path = url_rules.host_and_path()
    pages = pages.select("url", host.alias("host"), path.alias("path"))
    given = url_rules.given_rule(F.col("host"), F.col("path"), url_rules.GIVEN_RULES)
    assert {r[0]: (r[1], r[2]) for r in pages.select("url", *given).collect()} == fits


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(2)
    sets = []
    for _ in range(300):
        tokens = [f"{k}:{rng.randint(0, 2)}" for k in "abc"]
        block = tokens[0] == "a:0" and tokens[1] == "b:1" or rng.random() < 0.05
        sets.append((tokens, "block" if block else "allow"))
    frame = spark.createDataFrame(sets, "tokens array<string>, verdict string")
    rules = url_rules.mine_rules(frame, 0.02, 0.7)
    assert rules[-1].tokens == () and {r.verdict for r in rules} == {"allow", "block"}
    for rule in rules[:-1]:
        met = [v for t, v in sets if set(rule.tokens) <= set(t)]
        hits = met.count(rule.verdict)
        assert rule.confidence == pytest.approx(hits / len(met)) and rule.confidence >= 0.7
        assert hits >= 0.02 * len(sets)
    index = url_rules.RuleIndex(rules)
    for tokens, _ in sets:
        fired = {k for k, r in enumerate(rules) if set(r.tokens) <= set(tokens)}
        assert set(index.fired(tokens)) == fired


# Token files --------------------------------------------------------------


@pytest.fixture(scope="module")
def word_tokenizer():
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_token_file_query(spark, word_tokenizer):
    rows = sorted(run(spark, "op10_token_files"), key=lambda r: r["doc_id"])
    start = 0
    for (doc, text), r in zip(sorted(small("documents", "doc_id", "text")), rows, strict=True):
        ids = [*word_tokenizer.encode(text, add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (
            doc,
            start,
            len(ids),
            crc,
        )
        start += len(ids)


def test_spans_are_encoded_alike(word_tokenizer):
    rng = random.Random(9)
    pool = [*"abAB 12.,!'-=<", "'s", "'LL", " ", "\n", "\u00a0", "\u2003", "é", "e\u0301", "\u0338"]
    pool += ["ß", "İ", "Σ", "K", "中", "\U0001f642", "<|endoftext|>", "don't", "\u0345", "\x1f"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(4000)]
    data, offsets = text_bytes(pa.array(texts))
    encoder = token_files._Encoder(open(WORD_TOKENIZER, encoding="utf-8").read())
    ids, ends = encoder(data, offsets)
    for i, text in enumerate(texts):
        expected = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == expected, text


def test_token_file_edges(spark, tmp_path, word_tokenizer):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(edge_docs(spark), path, WORD_TOKENIZER)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == len(EDGE_TEXTS)
    assert [r["doc_id"] for r in rows] == [None, 0, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        at += r["n_tokens"]
    plan = token_files.read_tokens(spark, path).select("doc_id", "n_tokens")
    read = re.search(r"ReadSchema: (.*n_tokens.*)", plan._jdf.queryExecution().toString())
    assert "ids" not in read[1]
    token_files.write_tokens(empty_docs(spark), path, WORD_TOKENIZER)
    assert token_files.read_tokens(spark, path).collect() == []


def test_token_file_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    token_files.write_tokens(docs, path, WORD_TOKENIZER)
    for file in glob.glob(f"{path}/tokens/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(5)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
