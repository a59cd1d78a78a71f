"""Each operator against a brute-force version, with nulls, empty and repeated rows, and columns whose names clash."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, n_tokens string, key string, copy int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 90))) for _ in range(n // 2)]
    texts = base + [None, "", " \n\t", "x", "ab cd", "Word " * 70, "AAA b  c"]
    while len(texts) < n:
        words = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocab)
        texts.append(" ".join(words))
    r.shuffle(texts)
    return [(i * 3, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S10", None]), 0, 7, "x", "y", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(spark, docs, rows, none):
    from leadloom.llm.exact_dedup import drop_copies, exact_dedup

    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    got = by_id(exact_dedup(docs, prefix_chars=3))
    for i, t, *_ in rows:
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), sha(t or ""))
    assert sorted(r["doc_id"] for r in drop_copies(docs).collect()) == sorted(max(g) for g in groups.values())
    twice = docs.unionAll(docs)
    assert exact_dedup(twice).filter("kept").count() == len(groups)
    assert drop_copies(twice).count() == len(groups)
    assert exact_dedup(none).count() == 0 and drop_copies(none).columns == none.columns


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        out[i] = (len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("window,anchor", [(20, 8), (5, 2), (3, 3)])
def test_substring_dedup(docs, rows, none, window, anchor):
    from leadloom.llm.substrings import remove_repeats

    got = by_id(remove_repeats(docs, window, anchor))
    want = brute_repeats(rows, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    if window == 5:
        text = by_id(remove_repeats(docs, window, anchor, with_text=True))
        assert all(sha(r["kept"]) == r["kept_sha256"] and sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in text.values())
        assert remove_repeats(none).count() == 0
        assert sorted(r["n_removed"] for r in remove_repeats(docs.limit(0).unionAll(docs.filter("doc_id = 0")).unionAll(docs.filter("doc_id = 0"))).collect())[0] >= 0


def test_token_counts(docs, rows, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from leadloom.llm.token_counts import count_tokens, counter

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    got = by_id(count_tokens(docs, cache, path, ranks))
    for i, t, *_ in rows:
        assert got[i]["n_tokens"] == len(model.encode(t or "", add_special_tokens=False).ids) and got[i]["n_bytes"] == len((t or "").encode())
        assert not got[i]["cached"]
    again = by_id(count_tokens(docs, cache, path, ranks))
    assert all(r["cached"] and r["n_tokens"] == got[i]["n_tokens"] for i, r in again.items())
    assert docs.sparkSession.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows})
    assert count_tokens(none, str(tmp_path / "none"), path, ranks).count() == 0
    odd = ["<|endoftext|> a <|endoftext|>", "日本  語😀", "a\u0085b\u001fc", "I'll  \n\n x ", "  x"]
    assert counter(path, ranks)(odd) == [len(model.encode(x, add_special_tokens=False).ids) for x in odd]


def test_secrets(spark, none):
    from leadloom.llm.secrets import scan_secrets

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    kinds = [("assign", assign, lambda m: len(m[2]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]
    live, copied = "Zx9-live-credential", "example0example0"
    texts = [
        None, "", f"é😀 PassWord = '{live}' end", f"see {live} again", f"token:{copied}", f"api_key={copied} {copied}", f"secret: {copied}", "AKIA" + "Q" * 14 + " AKIAQ AKIA" + "7" * 20,
        "ab 0123456789abcdef0 0123456789abcde", "token: secret = abcdefghijklmnop token==aaaaaaaaaaaa", "password: short password:longenoughvalue1,secret:x",
    ]
    docs = spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = by_id(scan_secrets(docs))
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        base = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == sha(base), (t, base, got[i]["spans"])
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
    assert got[3]["spans"] == f"copy:4:{4 + len(live)}" and got[2]["n_live"] == 1 and got[4]["n_example"] == 1
    assert "copy" not in got[5]["spans"]
    assert scan_secrets(none).count() == 0


def test_mixing(docs, rows, none):
    from leadloom.llm.mixing import mix_sources, mixed_documents

    got = by_id(mix_sources(docs))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total = collections.Counter()
    for i, _, _, s, *_ in rows:
        total[s] += size[i]
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), sum(total.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        target.update(share)
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 3 * total[s]
            left -= 3 * total[s]
    taken = collections.Counter()
    for i, _, _, s, *_ in rows:
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == total[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[i] and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert [tuple(r) for r in mix_sources(docs).drop("row_id").collect()] == [tuple(r) for r in mix_sources(docs.repartition(5)).drop("row_id").collect()]
    out = collections.Counter(r["doc_id"] for r in mixed_documents(docs).collect())
    assert out == {i: r["copies"] for i, r in got.items() if r["copies"]}
    assert mix_sources(none).count() == 0 and mixed_documents(none).columns == none.columns


def test_pieces(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    from leadloom.llm.pieces import PieceEncoder, encode_pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceEncoder(path)
    got = by_id(encode_pieces(docs, path))
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    r = random.Random(2)
    for _ in range(1500):
        t = "".join(r.choice("ab cethz  \n.,()\rÉé▁😀<>語ing") for _ in range(r.randint(1, 50)))
        assert own.encode(t) == lib.encode(t) and own.decode(own.encode(t)) == lib.decode(lib.encode(t))
    assert encode_pieces(none, path, with_ids=True).count() == 0


def test_fingerprints(docs, rows, none, spark):
    from leadloom.llm.fingerprints import differences, digests, edited, fingerprint_documents

    texts = [t or "" for _, t, *_ in sorted(rows)]
    for pieces in (1, 5):
        got = [r for r in sorted(fingerprint_documents(docs, pieces).collect(), key=lambda r: r["doc_id"])]
        assert len(got) == len(texts)
        for k, r in enumerate(got):
            follow = texts[(k + 1) % len(texts)]
            new = edited(texts[k], follow)
            a, b, c = (set(digests(x).tolist()) for x in (texts[k], new, follow))
            dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
            assert r["edited_sha256"] == sha(new) and r["n_chars"] == len(texts[k])
            assert r["near_edited"] == pytest.approx(dice(a, b)) and r["near_next"] == pytest.approx(dice(a, c))
        prints = {t: r["fingerprint"] for t, r in zip(texts, got)}
        assert all(r["fingerprint"] == prints[t] for t, r in zip(texts, got))
    many = digests("\n".join(f"line {i}" for i in range(3000)))
    left, right, cells = differences([many], [many[:5]])
    assert (left[0], right[0]) == (2995, 0) and cells[0] > 48
    assert fingerprint_documents(none).count() == 0
    assert fingerprint_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).count() == 3


def brute_components(rows, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, copies, size, edits):
    """A large group of near copies: candidates by frequent tokens, several blocks."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(size)]
    out = []
    for i in range(copies):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(size)] = f"v{r.randrange(10**6)}"
        out.append((i, " ".join(words[: size - r.randint(0, 8)])))
    return out


@pytest.mark.parametrize("width,percent,frequent,heavy,block", [(4, 85, 32, 16, 512), (4, 85, 3, 2, 7), (5, 80, 2, 3, 10)])
def test_jaccard(spark, docs, rows, none, monkeypatch, width, percent, frequent, heavy, block):
    from leadloom.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    kin = [(1000 + i, t, None, None, 0, 1, "", "", 0) for i, t in family(3, 70, 60, 4)]
    every = list(rows) + kin
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(every, SCHEMA).repartition(3), width, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(every, width, percent)
    if block == 512:
        kept = {r["doc_id"] for r in jaccard.one_of_each(docs, width, percent).collect()}
        want = brute_components(rows, width, percent)
        assert kept == {i for i, (n, c) in want.items() if not n or c == i}
        assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("last", [0, 100_000])
def test_components(spark, monkeypatch, last):
    from leadloom.operators import graph
    from leadloom.operators.graph import connected_components

    monkeypatch.setattr(graph, "LAST_EDGES", last)
    r = random.Random(4)
    for edges in ([(i, i + 1) for i in range(60)], [(r.randrange(90), r.randrange(90)) for _ in range(50)], [(5, 5)], [(-3, 2**62), (2**62, 7), (None, 1)]):
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root}


def tongue(r, kind):
    parts = {"en": ["th", "ing", "er", "wh", "and"], "fr": ["eau", "oi", "é", "que", "ment"], "de": ["sch", "ung", "keit", "ver", "ß"]}[kind]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))


def test_language(spark, none):
    from leadloom.llm.language import identify_language

    r = random.Random(1)
    rows = [(i, tongue(r, k := r.choice(["en", "fr", "de"])), k) for i in range(300)] + [(900, None, "en"), (901, "123 !?", "en"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(identify_language(docs))
    held = [(i, k) for i, _, k in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held) and sum(got[i]["lang_pred"] == k for i, k in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and all(0 <= x["score"] <= 1 for x in got.values())
    assert {x["lang_pred"] for x in identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_language(none).count() == 0


def test_toxicity(spark, none):
    from leadloom.llm.toxicity import drop_toxic, score_toxicity

    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = tongue(r, "en").split()
        words += [r.choice(["vile", "nasty", "rotten"]) for _ in range(len(words) // 10 + 2)] * bad
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(score_toxicity(docs, marks))
    held = [(i, b) for i, b in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == b for i, b in held) >= 0.95 * len(held)
    assert all((x["score"] >= 0.7) == (x["predicted"] == 1) and 0 <= x["score"] <= 1 for x in got.values())
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    kept = {x["doc_id"] for x in drop_toxic(docs, marks).collect()}
    assert kept == {i for i, x in got.items() if not x["predicted"]}
    assert score_toxicity(none, marks).count() == 0
    assert {x["predicted"] for x in score_toxicity(docs, marks.limit(0)).collect()} == {0}


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(r[0], 0) for r in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    out = p.run(spark, str(tmp_path))
    at = docs
    for name, stage in p.STAGES[:4]:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == docs.columns, name
    last = {r[1] for r in at.select("doc_id", "text").collect()}
    assert out.count() == at.count() and len(last) <= len(rows)


def test_toxicity_reads_words_to_their_end(spark):
    from leadloom.llm.toxicity import score_toxicity

    r = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        ends = ["".join(r.choice("bcdfgh") for _ in range(5)) for _ in range(20)] + [r.choice(["vile", "nasty", "rotten"]) + r.choice("bcdfgh") for _ in range(8)] * (i % 3 == 0)
        rows.append((i, " ".join(f"commonbeginning/{x}" for x in ends)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(score_toxicity(docs, marks))
    held = [(i, b) for i, b in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == b for i, b in held) >= 0.95 * len(held)


def test_secrets_copied_bare_or_in_one_source(spark):
    from leadloom.llm.secrets import scan_secrets

    bare, hot = "copied1everywhere", "onesource1example"
    texts = [(f"token: {bare}", "s0")] + [(f"see {bare} again", f"s{i}") for i in (1, 2, 3)] + [(f"token: {hot}", "hot")] * 25
    got = by_id(scan_secrets(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, source string")))
    assert [got[0][c] for c in ("n_live", "n_example", "repositories")] == [0, 1, 4] and not any(got[i]["spans"] for i in (1, 2, 3))
    assert [got[9][c] for c in ("n_live", "n_example", "repositories")] == [0, 1, 25]


def twins():
    """Two words of 1,024 bytes whose polynomial hashes modulo 2^64 are equal for every base and choice of byte values."""
    return tuple("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))


def test_words_that_polynomial_hashes_confuse(spark):
    from leadloom.llm.jaccard import jaccard_components
    from leadloom.llm.substrings import remove_repeats

    a, b = twins()
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, a), (4, b), (5, f"{b} {tail}")], "doc_id long, text string")
    assert {i: r["n_removed"] for i, r in by_id(remove_repeats(docs)).items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    assert {i: r["component_id"] for i, r in by_id(jaccard_components(docs, percent=90)).items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}
    with pytest.raises(ValueError):
        jaccard_components(docs, percent=50)


def test_rows_not_ids_are_dropped(spark):
    from leadloom.llm.exact_dedup import drop_copies
    from leadloom.llm.jaccard import one_of_each
    from leadloom.llm.toxicity import drop_toxic

    base = " ".join(f"word{i}" for i in range(40))
    near = base + " more"
    rows = [(3, base, "x"), (5, near, "y"), (5, "a text of its own that nothing else is like", "z"), (9, "twice", "u"), (9, "twice", "v"), (None, None, "n"), (None, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id string")
    texts = lambda df: sorted(str(r["text"]) for r in df.collect())
    assert texts(one_of_each(docs)) == sorted(["", "None", base, rows[2][1], "twice"])
    assert texts(drop_copies(docs)) == sorted([base, near, rows[2][1], "twice", "None" if "None" in texts(drop_copies(docs)) else ""])
    many = [(i, f"plain words number {i % 7} " * 5 + ("vile rotten scum " * 9 if i % 3 == 0 else "")) for i in range(240)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in many], "doc_id long, toxic int")
    mixed = many + [(1, "vile rotten scum " * 30), (None, "vile rotten scum " * 30), (3, "plain words number 1 " * 9), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in drop_toxic(spark.createDataFrame(mixed, "doc_id long, text string"), marks).collect()]
    assert (3, "plain words number 1 " * 9) in kept and (None, None) in kept and not any("vile" in (t or "") for _, t in kept)
    assert len([1 for i, _ in kept if i == 1]) == 1


def test_stored_fingerprints_can_be_peeled(spark):
    from leadloom.llm.fingerprints import digests, fingerprint_documents, subtract

    lines = [f"paragraph {i} of a text" for i in range(30)]
    texts = ["\n".join(lines), "\n".join(lines[2:] + ["a new one"]), "\n".join(f"other {i}" for i in range(90))]
    got = by_id(fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    a, b = (set(digests(t).tolist()) for t in texts[:2])
    assert subtract(got[0]["fingerprint"], got[1]["fingerprint"]) == (a - b, b - a)
    assert subtract(got[0]["fingerprint"], got[0]["fingerprint"]) == (set(), set())
    assert subtract(got[0]["fingerprint"], got[2]["fingerprint"]) is None


def test_one_very_long_text(spark):
    from leadloom.llm.mixing import mix_sources
    from leadloom.llm.secrets import scan_secrets

    n = 12000
    secrets = "\n".join(f"token: abcdefghijkl{i:07d} 0123456789abcdef{i:08x}" for i in range(n))
    blank = " " * 1_000_000 + "a" + "\t" * 1_000_000 + "b c" + " " * 1_000_000
    docs = spark.createDataFrame([(1, secrets, "s"), (2, blank, "s"), (3, "x abcdefghijkl0000007 y", "t")], "doc_id long, text string, source string")
    got = by_id(scan_secrets(docs))
    assert (got[1]["n_assign"], got[1]["n_hex"]) == (n, n) and got[3]["spans"] == "copy:2:21"
    spans = sorted((m.start(), 0, m.end()) for m in re.finditer(r"token: [a-z0-9]+", secrets)) + sorted((m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{16,}", secrets))
    assert got[1]["base_sha256"] == sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))
    assert by_id(mix_sources(docs))[2]["size"] == 3


def test_kneser_ney_against_brute_force(spark):
    """Discounts, the chain of continuation counts, both classes' models and the score of texts, from their definitions."""
    import math

    from leadloom.llm.toxicity import CHAIN, PRIOR_WORDS, Ratios, continuations, count_beginnings, estimate_discounts, kneser_ney

    r = random.Random(7)
    words = ["idiot", "idle", "ideal", "the", "then", "scum", "scumbag", "a"]
    texts = [(" ".join(r.choice(words[: 8 if k else 5]) for _ in range(6)) + f" {r.choice(words)}{r.choice('xyz')}{i % 9}", k) for i in range(40) for k in (0, 1)]
    counts = {0: collections.Counter(), 1: collections.Counter()}
    for t, k in texts:
        counts[k].update({(w[:i], (w + " ")[i]) for w in t.split() for i in range(len(w) + 1)})
    both = counts[0] + counts[1]

    def estimate(ns, explained=(0, 0, 0)):
        items = [sum(n == i for n in ns) for i in range(5)]
        y = items[1] / (items[1] + 2 * items[2]) if items[1] and items[2] else 0.5
        again = [(n + 1) * items[n + 1] / items[n] if items[n] else 0 for n in (1, 2, 3)]
        return [min(n, max(y * n / 2, n - max(0, again[n - 1] - explained[n - 1]))) for n in (1, 2, 3)]

    total = lambda own, context: sum(n for (c, _), n in own.items() if c == context)

    def explained(own, other):
        each = collections.defaultdict(list)
        for (c, b), n in own.items():
            each[n].append(total(own, c) * other[c, b] / total(other, c) if total(other, c) else 0)
        return [sum(each[n]) / len(each[n]) if each[n] else 0 for n in (1, 2, 3)]

    discounts = {"toxic": estimate(counts[1].values(), explained(counts[1], counts[0])), "ordinary": estimate(counts[0].values(), explained(counts[0], counts[1])), "both": estimate(both.values())}
    minus = lambda n, d: d[min(n, 3) - 1] if n else 0
    levels = [collections.Counter((c[-CHAIN:], b) for c, b in both)]
    for length in range(CHAIN - 1, -1, -1):
        levels.append(collections.Counter((c[len(c) - length :] if length and len(c) > length else c if length else "", b) for c, b in levels[-1]))
    levels.reverse()

    def level(own, context, byte, low, d):
        inside = [n for (c, _), n in own.items() if c == context]
        if not inside:
            return low
        n = own[context, byte]
        return (n - minus(n, d) + sum(minus(x, d) for x in inside) * low) / sum(inside)

    def base(context, byte):
        p = 1 / 256
        for length, own in enumerate(levels):
            p = level(own, context[-length:] if length else "", byte, p, estimate(own.values()))
        return p

    def ratio(context, byte):
        shared = level(both, context, byte, base(context, byte), discounts["both"]) if (context, byte) in both else 1e-3  # what it is cancels
        return math.log(level(counts[1], context, byte, shared, discounts["toxic"]) / level(counts[0], context, byte, shared, discounts["ordinary"]))

    sample = spark.createDataFrame([(t, k, 0) for t, k in texts], "text string, toxic int, part int")
    rows = count_beginnings(sample).selectExpr("hash", "context", "byte", "before", "toxic[0] as toxic", "ordinary[0] as ordinary")
    got = continuations(rows)
    for x in got.collect():
        context = int(x["before"]).to_bytes(CHAIN, "big").strip(b"\0").decode()
        assert x["base"] == pytest.approx(base(context, chr(x["byte"]))), (context, x["byte"])
    found = estimate_discounts(rows)
    assert {k: pytest.approx(v) for k, v in discounts.items()} == found
    assert any(0 < d % 1 for v in found.values() for d in v)
    table = kneser_ney(rows.join(got, ["before", "byte"]), found).toPandas()
    own, back = table[~table["is_context"]], table[table["is_context"]]
    assert len(own) == len(both) and len(back) == len({c for c, _ in both})  # however rare
    model = Ratios(*[x for part in (own, back) for x in (part["hash"].to_numpy().view("uint64"), part["value"].to_numpy())])
    for text in ["idiot the scumbag", "the then ideal", "idiotic scum a", "unseen words", "a", "thex1 idley5"]:
        each = [sum(ratio(w[:i], (w + " ")[i]) for i in range(len(w) + 1)) for w in text.split()]
        scores = model.score([text.encode()], (1.0, 0.01))
        for share, x in zip((1.0, 0.01), scores[:, 0]):
            want = sum(math.log(1 - share + share * math.exp(w)) if share < 1 else w for w in each) / (len(each) + PRIOR_WORDS)
            assert x == pytest.approx(want, abs=1e-5), (text, share)


def test_toxicity_calibration_is_chosen_on_the_sample():
    """The choice among shares and weights is the best F1 of a logistic curve, here found by trying all."""
    import numpy as np

    from leadloom.llm.toxicity import SHARES, TOXIC_WEIGHTS, calibrate, choose_calibration

    r = np.random.default_rng(3)
    y = (r.random(400) < 0.2).astype(float)
    x = np.stack([r.normal(size=400) + y * (1 + (i == 3)) for i in range(len(SHARES))])

    def f1(slope, offset, each):
        found = slope * each + offset >= np.log(0.7 / 0.3)
        return 2 * (found & (y > 0)).sum() / (found.sum() + y.sum())

    share, slope, offset = choose_calibration(x, y)
    assert share == SHARES[3]
    best = max(f1(*calibrate(each, y, w), each) for each in x for w in TOXIC_WEIGHTS)
    assert f1(slope, offset, x[3]) == pytest.approx(best)
    assert choose_calibration(x, y * 0)[1:] == (1.0, -3.0)


def test_repeated_null_and_clashing_rows(spark):
    """Every operator over repeated rows, null ids, ties, an empty table, and columns with the names that operators use inside."""
    import public_tokenizers

    from leadloom.llm import exact_dedup, fingerprints, jaccard, language, mixing, pieces, secrets, substrings, token_counts, toxicity

    words = " ".join(f"word{i}" for i in range(25))
    rows = [(1, words), (1, words), (1, words + " end"), (2, words), (None, words), (None, None), (3, None), (3, ""), (4, "x" * 40_000), (4, ("y" * 30 + " ") * 3000)]
    schema = "doc_id long, text string, lang string, source string, row_id string, n string, size string, key string, base string, kept string, toxic string, part string, rank string, digest string, sha string, piece string, x string, name string, copies string"
    full = spark.createDataFrame([(i, t, "en" if t else None, None if i == 2 else "s", *["z"] * 15) for i, t in rows], schema)
    none, model = full.limit(0), public_tokenizers.path("piece_bpe_32k.model")
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    jobs = {
        "language": language.identify_language, "substrings": substrings.remove_repeats, "secrets": secrets.scan_secrets, "mixing": mixing.mix_sources, "pieces": lambda d: pieces.encode_pieces(d, model),
        "tokens": lambda d: token_counts.count_tokens(d, token_counts.new_table(spark, "cache"), public_tokenizers.path("byte_bpe_50k.json")), "fingerprints": fingerprints.fingerprint_documents,
        "jaccard": jaccard.jaccard_components, "toxicity": lambda d: toxicity.score_toxicity(d, marks), "exact": exact_dedup.exact_dedup,
    }
    for name, job in jobs.items():
        got = job(full).collect()
        assert len(got) == len(rows), name
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows), name
        assert job(none).count() == 0, name
    for name, job in {"copies": exact_dedup.drop_copies, "near": jaccard.one_of_each, "toxic": lambda d: toxicity.drop_toxic(d, marks), "mixed": mixing.mixed_documents}.items():
        assert job(full).columns == full.columns and job(none).count() == 0, name
    assert exact_dedup.drop_copies(full).count() == len({t or "" for _, t in rows})


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on planted toxic texts, copies and near copies; each is redone in plain Python."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from leadloom.llm.toxicity import score_toxicity

    r = random.Random(11)
    texts = [tongue(r, r.choice(["en", "fr", "de"])) for _ in range(330)]
    toxic = {i for i in range(330) if i % 3 == 0}
    for i in toxic:
        texts[i] += " vile rotten scum" * (3 + len(texts[i].split()) // 12)
    texts += [texts[1], texts[1], texts[4] + " tail", None, "", " "]
    rows = [(i, t, "en", ["s1", "s2", None][i % 7 % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(330)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    bad = {x["doc_id"] for x in score_toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("predicted = 1").collect()}
    assert len(bad & toxic) > 0.9 * len(toxic) and len(bad - toxic) < 10
    left = [x for x in rows if x[0] not in bad]
    last = {x[1] or "": x[0] for x in left}
    left = [x for x in left if last[x[1] or ""] == x[0]]
    group = brute_components([(x[0], x[1]) for x in left], 5, 80)
    left = [x for x in left if not group[x[0]][0] or group[x[0]][1] == x[0]]
    size = {x[0]: len(WORD.findall(x[1] or "")) for x in left}
    total = collections.Counter()
    for x in left:
        total[x[3]] += size[x[0]]
    weight = {s: (5, 2, 1)[k] for k, s in enumerate(sorted(s for s in total if s is not None) + [None] * (None in total))}
    target, free, rest = {}, set(total), sum(total.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        target.update({s: 3 * total[s] for s in over})
        rest, free = rest - sum(3 * total[s] for s in over), free - over
    target.update(share)
    wanted, lib = collections.Counter(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for s in total:
        start, passes = 0, int(target[s] // total[s])
        for x in sorted((x for x in left if x[3] == s), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0])):
            copies = (passes + (round(target[s] - passes * total[s]) > start)) if size[x[0]] else 0
            start += size[x[0]]
            ids = lib.encode(x[1] or "")
            wanted[(x[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))] += copies
    got = collections.Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +wanted and not any(i in bad for i, *_ in got)
