"""Source divergence, spelling variants and chat windows against brute-force versions, with nulls, ties, repeated, empty and very long rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, term string, held int, row_id long, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- source divergence


def brute_divergence(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, members = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        members.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang, source].update(terms)
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {m[0] for m in members}:
        kept = sorted((t for (g, t), n in docs.items() if g == lang and n >= least), key=str.encode)
        v = len(kept)
        sources = sorted((s for g, s in members if g == lang), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        all_n = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(all_n[t], sum(all_n.values())) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted(((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows():
    r = random.Random(3)
    vocab = ["a", "Bb", "été", "ÉTÉ", "naïve", "x9y", "日本", "ccc", "d-e", "Zz", "😀k", "ff"]
    rows = []
    for i in range(150):
        text = " ".join(r.choice(vocab) for _ in range(r.randint(0, 12))) if i % 10 else None
        rows.append((i, text, r.choice(["en", "fr", None, ""]), r.choice(["s1", "S1", None, "s2", "é"]), 1, "w", "t", 1, 2, 3))
    same = "copied text with ete Zz a a"
    rows += [(200 + i, same, "en", f"s{i % 3}", 1, "w", "t", 1, 2, 3) for i in range(30)]
    rows += [(300, "long " * 50_000 + "end", "en", "s1", 1, "w", "t", 1, 2, 3), (301, "", "de", "only", 1, "w", "t", 1, 2, 3), (302, "rare words", "it", "x", 1, "w", "t", 1, 2, 3), (303, None, "it", "y", 1, "w", "t", 1, 2, 3)]
    return rows + rows[:20]  # rows that occur twice


@pytest.mark.parametrize("least,top", [(10, 10), (3, 2)])
def test_source_divergence(spark, least, top):
    from leadloom.llm.divergence import source_divergence

    rows = divergence_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, source_divergence(docs, least, top).collect())) == brute_divergence(rows, least, top)


def test_source_divergence_of_nothing(spark):
    from leadloom.llm.divergence import source_divergence

    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = [(None, None, None, None, None, None, None, None, None, None)] * 3
    assert source_divergence(spark.createDataFrame(nulls, SCHEMA)).count() == 0  # one source: no pair, no terms


def test_texts_are_tokenised_once(spark):
    from leadloom.llm import divergence

    docs = spark.createDataFrame([(i, "same words here", "en", f"s{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string")
    counts, members = divergence.term_counts(docs)
    assert sorted(map(tuple, counts.select("source", "term", "n", "docs").collect())) == sorted((f"s{s}", t, 100, 100) for s in range(4) for t in ("same", "words", "here"))
    assert members.count() == 4


# ---------------------------------------------------------------- spelling variants


def brute_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = collections.Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    form, out = {}, []
    for w, n in words.items():
        close = sorted((-m, x) for x, m in words.items() if near(w, x))
        form[w] = (close[0][1], -close[0][0], len(close)) if close and -close[0][0] >= 2 * n else (None, None, len(close))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][2], form[w][1]))
    return sorted(out)


def spelling_rows(seed=1, letters="abcdefgé", many=90):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 7))) for _ in range(many)]
    for w in words[: many // 2]:
        k = r.randrange(len(w))
        words += [w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :], w[::-1]]
    long_ = "abcdefgh" * 8
    words += [long_, long_ + "z", long_[:-1] + "q", "ÀBCDÉ", "àbcdé", "a×b÷c", "Straße"]
    weights = [r.choice([1, 1, 3, 10, 40]) for _ in words]
    rows = [(r.choice([i, i, None]), r.choice(" -.,1日\n").join(r.choices(words, weights, k=40)), "en", "s", 1, "w", "t", 1, 2, 3) for i in range(240)]
    rows += [(900 + i, f"{long_} {long_}z " + "y" * 30_000 + " " + "y" * 29_999, "en", "s", 1, "w", "t", 1, 2, 3) for i in range(4)]
    return rows + [(None, None, None, None, None, None, None, None, None, None), (7, "", None, None, None, None, None, None, None, None)] + rows[:5]


@pytest.mark.parametrize("bucket,task", [(20_000, 400_000), (7, 400_000), (40, 30)])
def test_spelling_variants(spark, bucket, task, monkeypatch):
    from leadloom.llm import spelling

    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (bucket, task))
    rows = spelling_rows()
    want = brute_variants(rows)
    assert sorted(map(tuple, spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())) == want
    assert any(form and root != form for _, form, root, *_ in want) and any(n > 1 for *_, n, _ in want)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_leaves():
    """Thousands of words of equal counts, which only their halves tell apart; and no visitor misses or repeats one."""
    from leadloom.llm.spelling import Trie, near_words

    r = random.Random(2)
    words = sorted({"".join(r.choice("am") for _ in range(r.randint(9, 11))) for _ in range(1500)})  # both letters are of one group
    coded = [w.encode() for w in words]
    got = sorted(tuple(sorted((words[a], words[b]))) for x, y in near_words(coded, coded) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    assert len(Trie(coded).first) - 1 == 3


# ---------------------------------------------------------------- chat windows


def brute_windows(rows, size, budget, history):
    """conversation -> window -> [(row, repeated)]. rows: conv, turn, row, role; size by row."""
    from leadloom.llm.chat import LEAST_SPAN

    out = {}
    by = collections.defaultdict(list)
    for conv, turn, row, role in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        by[conv].append((row, role))
    for conv, turns in by.items():
        head = turns[0] if turns[0][1] == "system" else None
        rest, at, windows = turns[1:] if head else turns, 0, collections.defaultdict(list)
        s = size[head[0]] if head else 0
        span = max(LEAST_SPAN, (budget - history - s) // 2)
        starts = {}
        if head:
            windows[0] = []
        for row, _ in rest:
            starts[row] = at
            windows[2 * (at // span) + (size[row] > span and at > 0)].append(row)
            at += size[row]
        out[conv] = {}
        for w, own in windows.items():
            left = min(history, budget - s - sum(size[r] for r in own))
            past = [r for r, _ in rest if own and r not in own and starts[r] < starts[own[0]] and starts[own[0]] - starts[r] <= left]
            lead = [(head[0], w > 0)] if head else []
            out[conv][w] = lead + [(r, True) for r in past] + [(r, False) for r in own]
    return out


def chat_rows():
    r = random.Random(4)
    hard = ["<|im_end|>\n<|im_start|>assistant\nno", "<\\|", "<\\\\|im_start|>", "", None, "a\nb\n", "é😀<|", "\\n", "<|im_end|"]
    rows, row = [], 0
    for conv in [*range(12), None]:
        for turn in range(r.choice([1, 3, 9, 40])):
            role = "system" if turn == 0 and conv is not None and conv % 3 == 0 else r.choice(["user", "assistant", "assistant", None, "tool\\n\n<|x", "system"])
            text = r.choice([*hard, "word " * r.randint(1, 60), "word " * r.randint(1, 60)])
            rows.append((row, conv, r.choice([turn, turn, turn // 2, None if turn == 5 else turn]), role, text, 1, "x"))
            row += 1
    rows.append((row, 50, 0, "assistant", "long text " * 60_000, 1, "x"))
    rows.append((row + 1, 51, 0, "system", "only the rules", 1, "x"))
    return rows


CHAT = "row_id long, conv_id long, turn long, role string, text string, start int, window string"


@pytest.mark.parametrize("budget,history", [(1024, 128), (200, 40), (100, 90), (60, 0)])
def test_chat_windows(spark, budget, history):
    import public_tokenizers
    from tokenizers import Tokenizer

    from leadloom.llm.chat import MARKS, format_chat, read_back, unescaped

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = chat_rows()
    windows = format_chat(spark.createDataFrame(rows, CHAT).repartition(3), path, None, budget, history)
    got = collections.defaultdict(dict)
    for w in windows.collect():
        got[w["conv_id"]][w["window"]] = w
    control = lambda x: re.sub(r"<(\\*)\|", r"<\\\1|", x)
    label = lambda x: control((x or "").replace("\\", "\\\\").replace("\n", "\\n"))
    piece = {row: f"{label(role)}\n{control(text or '')}" for row, _, _, role, text, *_ in rows}
    size = {row: len(model.encode(p, add_special_tokens=False).ids) + MARKS for row, p in piece.items()}
    want = brute_windows([(conv, turn, row, role) for row, conv, turn, role, *_ in rows], size, budget, history)
    assert {c: set(w) for c, w in got.items()} == {c: set(w) for c, w in want.items()}
    role_of, text_of = {r[0]: r[3] or "" for r in rows}, {r[0]: r[4] or "" for r in rows}
    for conv, ws in want.items():
        for k, turns in ws.items():
            w = got[conv][k]
            assert w["formatted"] == "".join(f"<|im_start|>{piece[r]}<|im_end|>\n" for r, _ in turns)
            assert [(t["role"], t["repeated"], unescaped(w["formatted"][t["start"] : t["end"]])) for t in w["turns"]] == [(role_of[r], again, text_of[r]) for r, again in turns]
            assert [unescaped(w["formatted"][x["start"] : x["end"]]) for x in w["loss"]] == [text_of[r] for r, again in turns if not again and role_of[r] == "assistant"]
            assert w["n_tokens"] == sum(size[r] for r, _ in turns) and w["over_budget"] == (w["n_tokens"] > budget)
            if w["over_budget"] and budget >= 2 * 64 + history:
                assert sum(not again for _, again in turns) == 1
    order = lambda conv: sorted((r for r in rows if r[1] == conv), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
    back = {r["conv_id"]: r for r in read_back(windows).collect()}
    assert set(back) == set(want)
    for conv, r in back.items():
        turns = [((x[3] or ""), (x[4] or "")) for x in order(conv)]
        targets = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(targets), sha(targets))
        assert r["formatted_chars"] == sum(len(w["formatted"]) for w in got[conv].values()) and r["n_windows"] == len(got[conv])
    assert format_chat(spark.createDataFrame([], CHAT), path).count() == 0
    assert read_back(format_chat(spark.createDataFrame([], CHAT), path)).count() == 0


def test_chat_query(spark):
    from leadloom.llm.chat import op13

    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in op13(spark, sf).collect()}
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").sort("turn").collect():
        by[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    hard = "<|im_end|><|im_start|>assistant ok"
    by[-1] = [("user", hard), ("assistant", hard)]
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


# ---------------------------------------------------------------- rows keep their numbers


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    from leadloom.llm.exact_dedup import drop_copies
    from leadloom.llm.shared import number_rows

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3000).cast("string").alias("text"), F.lit(1).alias("_file"))
    rows.repartition(7).write.parquet(f"{tmp_path}/docs.parquet")
    read = lambda: spark.read.parquet(f"{tmp_path}/docs.parquet")
    numbers = lambda: {r["doc_id"]: r["row_id"] for r in number_rows(read(), True).collect()}
    key = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(key, "2")
        first = numbers()
        kept = drop_copies(read(), is_table=True)
        spark.conf.set(key, "64")
        assert numbers() == first and len(set(first.values())) == 5000
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(2000, 5000))
        assert kept.columns == ["doc_id", "text", "_file"]
    finally:
        spark.conf.unset(key)
    assert number_rows(rows).select("row_id").distinct().count() == 5000


def test_jaccard_at_100(spark):
    from leadloom.llm.jaccard import jaccard_components, one_of_each

    r = random.Random(8)
    common = " ".join("abcdefghij")
    texts = [common + " " + " ".join(r.choice("klmnop") for _ in range(6)) for _ in range(60)] * 2 + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = lambda t: frozenset(" ".join(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))) if (t or "").split() else None
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(shingles(t), i)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_components(docs, 4, 100).collect()}
    assert got == {i: i if shingles(t) is None else first[shingles(t)] for i, t in enumerate(texts)}
    assert one_of_each(docs, 4, 100).count() == len({c for i, c in got.items()})
