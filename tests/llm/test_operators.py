"""Each operator beside a plain Python version, on awkward documents, on a given table, and on an empty one."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from conftest import rows_of
from kinfold.llm import fuzzy_hash, gru_langid, mixing, nce_lm, partenum, secret_links, suffix_merge, token_counts, weak_rules, word_bpe

RANKS = word_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def same(df, want, columns):
    """Equal rows, as lists: ids may repeat or be null."""
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.fixture(params=["awkward", "documents", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def test_token_counts(table):
    pieces = {p for p in RANKS if len(p) > 1}
    longest = max(map(len, pieces))
    counts = {w: plain.greedy_count(w.encode(), pieces, longest) for _, t in rows_of(table) for w in set(plain.words(t))}
    want = [(i, len(plain.words(t)), sum(counts[w] for w in plain.words(t))) for i, t in rows_of(table)]
    same(token_counts.count_tokens(table, RANKS), want, ["doc_id", "n_words", "n_tokens"])


def test_automaton_random():
    rng = random.Random(3)
    for _ in range(100):
        pieces = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 6))) for _ in range(8)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90))) for _ in range(20)]
        automaton = token_counts.Automaton(pieces)
        want = [plain.greedy_count(w, pieces) for w in words]
        assert automaton.counts(words).tolist() == want == [automaton.count(w) for w in words]


def test_secrets_strong(table):
    want = []
    for i, t in rows_of(table):
        s = plain.strong_spans(t)
        text = ",".join(f"{secret_links.BASE[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(x[1] == k for x in s) for k in range(3)), plain.sha(text)))
    same(secret_links.find(table), want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])


def test_secrets_linked(awkward):
    got = {r["doc_id"]: r["spans"] for r in secret_links.find(awkward.where("doc_id IS NOT NULL")).collect()}
    assert got[18] == "ident:0:12,lesser:13:31,endpoint:35:59"  # name, secret and address within one scope
    assert got[19] == ""  # a weak secret alone; the name is too far away
    assert got[6] == "" and got[16].startswith("assign:0:25,access:30:50,hex:51:81")


def test_secrets_gap(spark):
    cases = {
        "auth: " + "k" * 220 + " client_id=foo": "lesser:0:226,ident:227:240",
        "client_id=foo auth: " + "k" * 220: "ident:0:13,lesser:14:240",
        "private_key=" + "Z" * 300 + " login: bob": "lesser:0:312,ident:313:323",
        "pwd: s3cr3tvalue99" + " " * 200 + "login: bob": "lesser:0:18,ident:218:228",
        "pwd: s3cr3tvalue99" + " " * 201 + "login: bob": "",
        "pwd: s3cr3tvalue99 at https://host/cb?token=abc123": "lesser:0:18,assign:38:50",  # the address is a partner only
        "https://h/" + "z" * 500 + "?auth=abcdefgh1&" + "z" * 500: "endpoint:0:1026,lesser:511:525",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r["spans"] for r in secret_links.find(docs).orderBy("doc_id").collect()] == list(cases.values())


def test_secrets_redacted(awkward):
    out = {r["doc_id"]: r for r in secret_links.redact(awkward).where("doc_id IS NOT NULL").collect()}
    assert out[18]["text"] == "[removed]\n[removed] at [removed]" and out[18]["n_chars"] == len(out[18]["text"])
    assert out[6]["text"] == plain.PROSE and out[6]["label"] == [6] and out[19]["text"].startswith("pwd: ")
    assert secret_links.redact(awkward).schema.names == awkward.schema.names
    assert secret_links.redact(awkward).count() == awkward.count()


def test_fingerprints(table):
    rows = rows_of(table)
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + after[:n]
        a, b, c = map(fuzzy_hash.fingerprint, (t, changed, after))
        want.append((i, len(t), plain.sha(changed), a, b, round(fuzzy_hash.alike(a, b), 6), round(fuzzy_hash.alike(a, c), 6)))
    same(fuzzy_hash.fingerprints(table), want, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def test_fingerprint_one_document(spark, awkward):
    row = fuzzy_hash.fingerprints(awkward.where("doc_id = 6")).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0


def test_edit_distance():
    rng = random.Random(1)

    def slow(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
            line = new
        return line[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert fuzzy_hash.edit_distance(a, b) == slow(a, b)


def test_language(documents):
    got = gru_langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 200 and {r["doc_id"] for r in held} == {r["doc_id"] for r in got if plain.held(r["doc_id"], 4, 2)}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward(awkward, empty):
    got = gru_langid.identify(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 5))
    assert by_id[6]["lang_pred"] in ("en", "de") and by_id[6]["lang_pred"] == by_id[7]["lang_pred"]
    assert gru_langid.identify(empty).count() == 0
    no_labels = awkward.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in gru_langid.identify(no_labels).collect()} == {"und"}
    kept = gru_langid.keep_identified(awkward)
    assert kept.schema.names == awkward.schema.names and {0, 1, 2, 5}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_recurrent_gradients():
    net = gru_langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    data, filled, labels = rng.integers(60, 70, (5, 64)).astype(np.uint8), np.array([64, 64, 10, 30, 64]), np.array([0, 1, 2, 1, 0])
    gradients, _ = net.gradients(data, filled, labels)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        at = (at[0], int(data[0, 3])) if k[0] == "w" else at
        old, losses = v[at], []
        for step in (1e-2, -1e-2):
            v[at] = old + step
            losses.append(net.gradients(data, filled, labels)[1])
        v[at] = old
        assert abs(gradients[k][at] - (losses[0] - losses[1]) / 2e-2) < 1e-5


def test_bpe(table):
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for i, t in rows_of(table):
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(t or "")))
    got = word_bpe.encode_decode(table, RANKS, public_tokenizers.PATTERN, with_ids=True)
    same(got, want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert all(plain.sha(",".join(map(str, r["ids"]))) == r["ids_sha256"] for r in got.collect())


def test_mixing(table):
    rows = table.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(plain.words(r["text"]))
    goal = plain.targets(sizes) if rows else {}
    want = [(r["doc_id"], len(plain.words(r["text"])), sizes[r["source"]], round(goal[r["source"]], 6)) for r in rows]
    out = mixing.taken_words(table)
    same(out, want, ["doc_id", "size", "source_size", "target"])
    got = out.collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for target in {r["target"] for r in got}:
        mine = [r for r in got if r["target"] == target]
        groups = len({r["source_size"] for r in mine})
        assert abs(sum(r["taken"] for r in mine) - target * groups) <= 2 * mixing.BLOCK * groups
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.taken_words(table).collect()))


def test_mix_texts(documents):
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(documents).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    words = dict.fromkeys(taken, 0)
    mixed = mixing.mix(documents)
    assert mixed.schema.names == documents.schema.names
    for r in mixed.collect():
        words[r["doc_id"]] += len(plain.words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(plain.words(r["text"])) <= set(plain.words(texts[r["doc_id"]]))
    assert words == taken


def test_apportion(spark):
    rng = random.Random(5)
    cells = [(g, i, float(rng.choice([0, 1, 5, 40, 900]) * rng.random()), seats) for g, seats in enumerate((0, 1, 7, 50, 1000)) for i in range(9)]
    out = mixing.apportion(spark.createDataFrame(cells, "g int, i int, votes double, seats long"), ["g"], "votes", "seats", ["i"]).collect()
    for g in range(5):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["i"])
        won = [0] * len(mine)
        for _ in range(mine[0]["seats"]):
            won[max(range(len(mine)), key=lambda k: (mine[k]["votes"] / (2 * won[k] + 1), -k))] += 1
        assert [r["quota"] for r in mine] == won


def test_language_model(table):
    out = nce_lm.score_texts(table)
    same(out, plain.base_scores(rows_of(table), nce_lm.MODULUS, nce_lm.HELD), ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"])
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out.collect())


def test_language_model_learns(documents):
    held = [r for r in nce_lm.score_texts(documents).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_noise_contrast_normalised():
    rng = np.random.default_rng(2)
    truth = rng.dirichlet(np.full(12, 0.4), 9)
    table = nce_lm.train(truth * rng.integers(500, 5000, (9, 1)), width=8)
    assert np.allclose((10**table).sum(axis=1), 1)
    assert np.abs(10**table - truth).mean() < 0.02


def test_quality(table):
    want = []
    for i, t in rows_of(table):
        m = plain.measures(t)
        want.append((i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    out = weak_rules.judged(table)
    same(out, want, ["doc_id", *weak_rules.MEASURES, "base_failed"])
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())


def test_quality_verdict(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weak_rules.judged(docs).where("NOT base_failed").join(labels.where("quality IS NOT NULL"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.6


def test_repeats(table):
    rows = rows_of(table)
    texts = [(t or "").encode() for _, t in rows]
    want = [(i, *w) for (i, _), w in zip(rows, plain.without_repeats(texts, suffix_merge.LENGTH))]
    if any(i is None for i, _ in rows):  # rows of one id come in any order; what is removed of them in all is fixed
        out = [r for r in suffix_merge.remove_repeats(table).collect()]
        assert sorted(r["n_bytes"] for r in out) == sorted(w[1] for w in want)
        once = table.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        rows = rows_of(once)
        want = [(i, *w) for (i, _), w in zip(rows, plain.without_repeats([(t or "").encode() for _, t in rows], suffix_merge.LENGTH))]
        table = once
    same(suffix_merge.remove_repeats(table), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_repeats_short_strings(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(40)] + ["a" * 50, "ab" * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = [(i, *w) for i, w in enumerate(plain.without_repeats([t.encode() for t in texts], 10))]
    same(suffix_merge.remove_repeats(docs, 10, 5), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@pytest.mark.parametrize("hot", [1, 3])
def test_repeats_hot_anchor(spark, hot):
    """A line with ever different neighbours: its strings are decided by string, not in one group of all contexts."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line = "we use cookies"
    texts = [some(rng.randint(0, 30)) + line + some(rng.randint(0, 30)) for _ in range(60)]
    texts += texts[:9] + [line * 3, line + "\0\0\0", line + "\0\0", "", some(15)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = [(i, *w) for i, w in enumerate(plain.without_repeats([t.encode() for t in texts], 20))]
    same(suffix_merge.remove_repeats(docs, 20, 8, hot=hot), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_repeats_hot_strings_are_split():
    batch = suffix_merge.pa.table({"doc_id": [3, 1, 2], "text": ["0123456789xx", "yy0123456789", "0123456789xx"]})
    c = suffix_merge.Contexts(batch, 10, 4)
    rows, again = suffix_merge.hot_strings(c, np.arange(len(c.first)), 10, 7)
    assert len(rows) > 1 and again.tolist() == [0, 1, 2, 24]  # copies of the strings at 14 (doc 1), 25 and 26 (doc 2)
    found = {}
    for b, blob in rows:
        for chunk, places in suffix_merge.decide_strings([5, 6], [blob, blob], 10):
            found.setdefault(chunk, []).extend(places.tolist())
    assert set(found) == {6} and sorted(found[6]) == [12, 13, 14, 25, 26]


def test_merge_runs():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 25))) for _ in range(7)]
    coded = [suffix_merge.front_coded([(k, len(k), [(0, 0)]) for k in run]) for run in runs]
    before, out = b"", []
    for _, shared, item in suffix_merge.merge_runs([suffix_merge.read_run(b) for b in coded]):
        assert shared == next((i for i, (x, y) in enumerate(zip(before, item[0])) if x != y), min(len(before), len(item[0])))
        out.append(before := item[0])
    assert out == sorted(k for run in runs for k in run)


def test_near_duplicates(table):
    same(partenum.near_duplicates(table), plain.components([(r["doc_id"], r["text"]) for r in table.collect()]), ["doc_id", "n_shingles", "component_id"])


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_cluster(spark, monkeypatch, small):
    """Many near copies whose links lie on both sides of the bound, over few words, so that signatures collide."""
    if small:  # every way that large groups take
        for name, value in {"SMALL_GROUP": 3, "HOT_SETS": 4, "FIRST_HUBS": 1, "BLOCK_SETS": 8}.items():
            monkeypatch.setattr(partenum, name, value)
    rng = random.Random(6)
    texts = []
    for base in range(4):
        words = [f"b{base}w{rng.randint(0, 30)}" for _ in range(rng.choice([6, 12, 40, 120]))]
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 20)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 5)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    same(partenum.near_duplicates(docs), plain.components(list(enumerate(texts))), ["doc_id", "n_shingles", "component_id"])


def test_signatures_complete():
    """Any two sets at the bound share a signature, whatever shingles are hot."""
    rng = np.random.default_rng(9)
    for n in [*range(1, 60), 100, 333, 1000]:
        for share in (0.0, 0.1, 0.5, 0.9, 1.0):
            keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            fewer = np.unique(keys[rng.permutation(len(keys))[: partenum.least_shared(len(keys))]])
            more = np.unique(np.concatenate([keys, rng.integers(0, 2**63, len(keys) // 3, dtype=np.uint64)]))

            def signs(some):
                return set(partenum.signatures(some, some % np.uint64(1000) < np.uint64(int(1000 * share))).tolist())

            assert signs(keys) & signs(fewer) and signs(keys) & signs(more)


def test_one_of_each(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    kept = partenum.one_of_each(awkward)
    assert kept.schema.names == awkward.schema.names
    groups = plain.components([(k, t) for k, (_, t) in enumerate(rows)])
    assert kept.count() == len({c for _, _, c in groups})
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 0 in ids and 1 in ids


def test_long_words_built_to_collide(spark):
    """Words of the Thue-Morse sequence and its mirror, on which any polynomial in the letters modulo 2^64 agrees."""
    signs = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)]
    sets = partenum.text_shingles(words)
    assert len(sets[0]) == len(sets[1]) == 1 and sets[0][0] != sets[1][0]
    docs = spark.createDataFrame([(i + 1, w) for i, w in enumerate(words + words[:1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
