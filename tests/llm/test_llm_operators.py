"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, common, decontaminate, licences, lines, mixing, near_dup, neighbours, quality, substrings, tokens
from quire.llm.common import connected
from quire.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeêß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 60, 150, 400]))) for _ in range(n)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    for k in range(0, n, 7):
        texts[k] = texts[k] + "\n" + passage + "\tEnd."
    texts += [texts[3], texts[3], texts[4].upper(), "", None, "  \n ", passage, passage + " x"]
    base = texts[7 * 3].split(" ")
    for k in range(12):
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(len(words))] = r.choice(vocab) + str(k)
        texts.append(" ".join(words))
    texts.append(" ".join(r.choice(vocab) for _ in range(20_000)))
    return [(i * 3, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def union_find(pairs, ids):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_word_hashes(monkeypatch):
    """Equal words and no others have equal hashes, however the texts' buffer is cut into slices."""
    monkeypatch.setattr(common, "_SLICE", 7)
    r, names = random.Random(1), {}
    for _ in range(200):
        texts = [None if r.random() < 0.1 else "".join(r.choice("ab \n\té") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6))]
        h, bounds = common.word_hashes(pa.array(["zz b", *texts, "q"], pa.string()).slice(1, len(texts)))
        words = [WORD.findall(t or "") for t in texts]
        assert np.diff(bounds).tolist() == [*map(len, words)]
        assert all(names.setdefault(w, x) == x for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True))
    assert len({*names.values()}) == len(names)


@pytest.mark.parametrize("links_a_task", [500_000, 20])
def test_connected(spark, links_a_task, monkeypatch):
    monkeypatch.setattr(common, "LINKS_A_TASK", links_a_task)
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    ids = {x for p in pairs for x in p}
    want = union_find(pairs, ids)
    got = {r.id: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in ids} == want


# --- chat ---


NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "a[\\/INST]b", "", "<", "[", "x\n<s", "s>", " [/INST]", "\\", "é</s>" * 50]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "a\nb", "[INST]", "<s>\\n", "\\"])
def test_turns_round_trip(role):
    for text in NASTY:
        segment, start, n, _ = chat.render_checked(role, text)
        assert [x[:2] for x in chat.parse(segment)] == [(role, text)]
        assert chat.unescape(segment[start : start + n]) == text
    whole = "".join(chat.render_checked(role, t)[0] for t in NASTY)
    assert [x[:2] for x in chat.parse(whole)] == [(role, t) for t in NASTY]


def test_broken_text_is_refused():
    for text in ("x", "<s>a", "[INST] user", "<s>a<s></s>"):
        with pytest.raises(ValueError):
            chat.parse(text)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (1, 2, "assistant", "é"), (1, 2, "assistant", "é")]
    rows += [(5, i, "assistant" if i % 2 else "user", NASTY[i % len(NASTY)]) for i in range(500)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    segments = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert len(got) == 4
    for conv in got:
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: r)
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in mine).encode()).hexdigest()
        loss = "".join(c for _, b, c in mine if b == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    again = {r.conv_id: r for r in chat.read_back(chat.in_order(segments.repartition(7))).collect()}
    assert again == got
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- quality ---


def test_quality(spark, docs, empty):
    r = random.Random(2)
    good = [(1000 + i, " ".join(r.choice(["the", "of", "and", "house", "river"]) for _ in range(80)) + ".") for i in range(150)]
    bad = [(2000 + i, " ".join(r.choice(["THE!!", "$$$", "x | y", "####"]) for _ in range(80))) for i in range(60)]
    table = spark.createDataFrame([*good, *bad, (1, ""), (2, None)], "doc_id long, text string").repartition(4)
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (7, None)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int").filter(~quality.held_out())
    model = quality.fit(table, marked)
    scored = {r.doc_id: r for r in quality.score(table.withColumn("score", F.lit("clash")), model).withColumn("held", quality.held_out()).collect()}
    assert len(scored) == len(good) + len(bad) + 2
    held = [(scored[i].score >= 0.3, q) for i, q in labels if i in scored and scored[i].held]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored if scored[i].held)
    assert np.mean([a == bool(b) for a, b in held]) > 0.95
    assert scored[1].score == scored[2].score and all(0 <= r.score <= 1 for r in scored.values())
    again = quality.fit(table.repartition(9), marked)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.values, again.values)
    assert {r.score for r in quality.score(table, quality.fit(table, marked.limit(0))).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


# --- mixing ---


def test_mixing(spark, docs, empty):
    sizes, per, of = {}, defaultdict(int), {}
    for d, t, _, s, _ in corpus():
        sizes[d], of[d] = len(WORD.findall(t or "")), s
        per[s] += sizes[d]
    names = sorted(x for x in per if x is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    capped, total = set(), sum(per.values())
    while True:
        rest, w = total - sum(3 * per[n] for n in capped), sum(weight[n] for n in names if n not in capped)
        target = {n: 3.0 * per[n] if n in capped else rest * weight[n] / w for n in names}
        over = {n for n in names if n not in capped and target[n] > 3 * per[n]}
        if not over:
            break
        capped |= over
    for chunk in (4096, 8):
        got = mixing.mix(docs.withColumn("size", F.lit("clash")), chunk_rows=chunk).select("doc_id", "mix.*").collect()
        assert len(got) == len(sizes)
        taken = defaultdict(int)
        for r in got:
            taken[of[r.doc_id]] += r.taken
            assert r["size"] == sizes[r.doc_id] and r.source_size == per[of[r.doc_id]] and 0 <= r.taken <= 3 * r["size"]
            assert r.target == pytest.approx(target[of[r.doc_id]])
        if chunk == 4096:
            most = {n: max(sizes[d] for d in sizes if of[d] == n) for n in names}
            assert all(abs(taken[n] - target[n]) <= 0.02 * target[n] + 5 for n in names if most[n] <= target[n])
    a, b = (sorted((r.doc_id, r.mix.taken) for r in mixing.mix(x).collect()) for x in (docs, docs.repartition(3)))
    assert a == b
    rows = mixing.repeated(mixing.mix(docs))
    assert rows.columns == docs.columns and rows.count() == sum(r.mix.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0


def test_tilts_solve_the_dual(spark):
    """Words taken at ``min(exp(tilt * size), 3)`` are the target, as bisection in numpy finds it."""
    r = random.Random(12)
    rows = [(s, r.choice([1, 2, 5, 40, 300, r.randint(1, 4000)])) for s in ("a", "b", None, "d", "e") for _ in range(80)] + [("f", 0)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    found = mixing.balanced(sizes, mixing.source_targets(sizes)).collect()
    assert len(found) == 6
    for x in found:
        n = np.array([k for s, k in rows if s == x.source], float)
        taken = lambda t: (n * np.minimum(3, np.exp(np.clip(t * n, -700, 700)))).sum()  # noqa: B023, E731
        if x.tilt is None:
            assert x.target in (0, 3 * n.sum()) or abs(x.target - 3 * n.sum()) < 1e-6
            continue
        lo, hi = -5.0, 5.0
        for _ in range(200):
            lo, hi = (lo, (lo + hi) / 2) if taken((lo + hi) / 2) > x.target else ((lo + hi) / 2, hi)
        assert taken(x.tilt) == pytest.approx(x.target, rel=1e-6) and x.tilt == pytest.approx(lo, rel=1e-3, abs=1e-9)
    assert sum(x.tilt is not None for x in found) >= 3


def test_mixing_stops_at_cap(spark):
    rows = [(i, "a b c", "a" if i else "b") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).select("source", "mix.*").collect()
    assert {r.source: r.target for r in got} == {"b": 9.0, "a": 141.0}
    assert [r.taken for r in got if r.source == "b"] == [9]


def test_native_plans(spark, docs):
    for df in (mixing.mix(docs), licences.scan(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- near duplicates ---


def brute_components(rows, width, percent):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids, pairs = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    return sets, union_find(pairs, ids)


@pytest.mark.parametrize("width,percent,hot", [(3, 85, None), (5, 80, None), (3, 85, 3)])
def test_near_duplicates(spark, docs, empty, width, percent, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(near_dup, "linked", lambda *a: __import__("quire.llm.common", fromlist=["linked"]).linked(*a, hot=hot))
        monkeypatch.setattr(near_dup, "BLOCK", 4)
    sets, want = brute_components(corpus(), width, percent)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs.withColumn("node", F.lit(1)), width, percent).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
    if width == 5:
        assert near_dup.near_duplicates(empty).count() == 0
        kept = near_dup.without_near_duplicates(docs.union(docs))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in sets if want[d] == d)
        again = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (1, "d e f", "z"), (1, "", "u"), (1, " ", "v"), (2, "a b c", "w")], "doc_id long, text string, part string")
        assert sorted(r.text for r in near_dup.without_near_duplicates(again).collect()) == ["", " ", "a b c", "d e f"]
        nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
        assert sorted((r.doc_id or 0, r.kept) for r in near_dup.near_duplicates(nulls).collect()) == [(0, True), (0, True), (1, True)]


def test_near_duplicates_beside_the_sketch_size(spark):
    """Sets that a sketch holds whole against slightly larger ones that it doesn't."""
    rows, pairs = [], []
    for k in range(30):
        for n in range(28, 33):
            for m in range(33, n * 100 // 85 + 1):
                ws = [f"w{len(rows)}x{i}" for i in range(m)]
                pairs.append(len(rows))
                rows += [(len(rows), " ".join(ws)), (len(rows) + 1, " ".join(ws[:n]))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()}
    assert [d for d in pairs if got[d + 1] != d] == []


def test_shared_bound():
    for t in (0.8, 0.85):
        c = near_dup.shared_at_least(32, t)
        assert 8 <= c <= 20


# --- tokens ---


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    extra = [(-5, "it's  two  spaces\n\n\nlines \n x"), (-4, "tail "), (-3, " head"), (-2, "tab\there<|endoftext|>x"), (-1, "don't we'll a'sb"), (-6, "\nfirst\nline.\nA")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    tokens.write(rows, f"file://{tmp_path}/out", vocabulary())
    got = {r.doc_id: r for r in tokens.read(spark, f"file://{tmp_path}/out").collect()}
    at = 0
    for d, text in sorted([(r[0], r[1]) for r in corpus()] + extra):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids) == (at, len(ids), ids)
        at += len(ids)
    digests = tokens.read(spark, f"file://{tmp_path}/out", digest=True).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(got[r.doc_id].ids, "<u4").tobytes()) for r in digests)
    tokens.write(empty, f"file://{tmp_path}/none", vocabulary())
    assert tokens.read(spark, f"file://{tmp_path}/none").count() == 0


def test_tokens_of_texts_with_nul():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary())
    for text in ("a \1 b", "\1", "a\n\1", "foo \0bar", "\0bar foo", "foo bar", "bar foo", "\0", "a \0", "a\0 b", "a \0\0b"):
        assert np.frombuffer(encode.batch(pa.array([text, "x"]))[0], "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_keeps_a_word_once_whatever_sign_follows():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary())
    texts = ["xyzzyq xyzzyq. xyzzyq, xyzzyq., a.", "xyzzyq,\nxyzzyq.\nÉléphañt élé. ñandú, \u01c5. \u0345. \u0391. ª, 7. ."]
    before = len(encode.pieces)
    got = encode.batch(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert {"xyzzyq", "\0xyzzyq", "ñandú"} <= set(encode.pieces)
    assert not {"xyzzyq.", "xyzzyq,", "\0xyzzyq.", "ñandú,"} & set(encode.pieces) and len(encode.pieces) > before


def test_encoder_keeps_a_bounded_number_of_pieces():
    """However many texts a worker has seen, it keeps ``most`` pieces and those of one slice, and ids stay the same."""
    from tokenizers import Tokenizer

    t, encode, rng = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary(), most=100), random.Random(5)
    common_words = [f"{w}{e}" for w in ("the", "größe", "été", "Ab") for e in ("", ".", ",", "!!")]
    for _ in range(20):
        words = ["".join(rng.choices("abcdeé", k=7)) for _ in range(40)] + common_words
        texts = [" ".join(rng.sample(words, 30)) + "\n" + " ".join(rng.sample(words, 9)) for _ in range(3)]
        got = encode.batch(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert 2 < len(encode.pieces) <= 100  # before, all were dropped, and only with the slice after


def test_counts_come_with_the_ids(spark, docs):
    """Each part ends with how often its ids occur, so ids aren't read once more to count them."""
    rows = tokens.tokenized(docs, vocabulary())
    held = rows.filter("counts is null").collect()
    want = Counter(i for r in held for i in tokens._unpacked(r.ids).tolist())
    assert tokens.global_counts(rows) == want and len(held) == docs.count()
    assert sum(r.at for r in rows.filter("counts is not null").collect()) == want.total()


def test_code_lengths_are_limited_and_best():
    counts = {i: 2**i for i in range(24)}
    bits = tokens.code_lengths(counts, 8)
    assert max(bits.values()) <= 8 and sum(2.0 ** -b for b in bits.values()) <= 1
    flat = tokens.code_lengths({i: 1 for i in range(8)}, 20)
    assert set(flat.values()) == {3}
    code = tokens.Code(tokens.code_lengths({1: 5, 2: 1, 9: 1, 40000: 3}))
    ids = np.random.default_rng(0).choice([1, 2, 9, 40000], 5000)
    payload, points = code.encode(ids)
    assert np.array_equal(code.decode([payload], [points], [len(ids)])[0], ids)
    one = tokens.Code(tokens.code_lengths({7: 3}))
    assert one.decode([one.encode(np.array([7] * 9))[0]], [np.array([0])], [9])[0].tolist() == [7] * 9


# --- lines ---


def test_lines(spark, empty):
    same = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{same}\n\nother line of five words"), (2, f"{same.upper()}!\nunique one here"), (3, same + "\n" + same), (4, None), (5, ""), (None, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("clash"))
    got = {r.doc_id: r.lines for r in lines.remove_repeated_lines(df).collect()}
    assert got[1].kept_text == rows[0][1] and got[1].n_lines == 3
    assert (got[2].kept_text, got[2].n_removed) == ("unique one here", 1)
    assert (got[3].kept_text, got[3].n_removed) == ("", 2)
    assert got[4].kept_text == got[5].kept_text == "" and got[None].kept_text == same
    assert lines.remove_repeated_lines(empty).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [" ".join(r.choice(vocab) for _ in range(40)) for _ in range(8)]
    made = [(i, "\n".join(b.replace(r.choice(b.split()), r.choice(vocab), 1) if r.random() < 0.7 else b for b in r.sample(base, 3))) for i in range(40)]
    got = {r.doc_id: r.lines.n_removed for r in lines.remove_repeated_lines(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    order = [(d, no, lines.normal_line(line)) for d, t in made for no, line in enumerate(t.split("\n"))]
    keys = sorted({key for *_, key in order})
    index = {k: i for i, k in enumerate(keys)}
    pairs = [(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys[:i]) if slow_distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)]
    part, seen, want = union_find(pairs, range(len(keys))), set(), Counter()
    for d, _, key in sorted(order, key=lambda x: x[:2]):
        p = part[index[key]]
        want[d] += p in seen
        seen.add(p)
    assert got == {d: want[d] for d, _ in made} and pairs


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_side_by_side():
    r = random.Random(5)
    one, two, most, want = [], [], [], []
    for n in [0, 1, 3, 40, 63, 64, 65, 150, 320] * 40:
        a = "".join(r.choice("abc é漢\U0001f600") for _ in range(n))
        b = list(a)
        for _ in range(r.randint(0, n // 6 + 1)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "漢"])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        one.append(a)
        two.append(b)
        most.append(max(0, row[-1] + r.randint(-2, 2)))
        want.append(row[-1] <= most[-1])
    for some in (len(one), 100):  # all side by side, and few enough to go one by one
        assert lines.within(one[:some], two[:some], np.array(most[:some])).tolist() == want[:some]


def test_pairs_of_many_common_lists_come_once(spark):
    """Two nodes that meet in many lists outside the first one's component are one pair, not one a list."""
    seen = []
    members = spark.createDataFrame([(v, node, 1) for v in range(8) for node in (1, 5, 9)], "v long, node long, first long")
    left, right = (spark.createDataFrame([(x,) for x in (1, 5, 9)], f"{c} long") for c in "ab")

    def confirmed(pairs):
        seen.append(sorted((r.a, r.b) for r in pairs.collect()))
        return pairs.filter("a = 5 and b = 9")

    got = common.linked(members, left, right, F.lit(True), confirmed, once=True).collect()
    assert seen[0] == [(1, 5), (1, 9)]
    assert sorted(tuple(sorted(p)) for p in seen[1]) == [(1, 5), (1, 9), (5, 9)]
    assert {r.id: r.component for r in got} == {9: 5}


def test_letter_pairs_bound_the_edit_distance():
    """Lines differ in four bits an edit at most, and unrelated ones in more than edit similarity 0.9 allows."""
    rng, alphabet = random.Random(11), "abcdefgh éñ日7.,  "
    one = ["".join(rng.choices(alphabet, k=rng.randrange(0, 90))) for _ in range(400)]
    two = []
    for line in one:
        letters = list(line)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randrange(2)] = rng.choices(alphabet, k=rng.randrange(3))
        two.append("".join(letters))
    a, b = (lines.letter_pairs(pa.array(["x", *x]).slice(1)) for x in (one, two))
    bits = np.unpackbits((a ^ b).view(np.uint8), axis=1).sum(axis=1)
    edits = [lines.edit_distance(lines.normal_line(x), lines.normal_line(y), 10**6) for x, y in zip(one, two, strict=True)]
    assert all(n <= 4 * e for n, e in zip(bits.tolist(), edits, strict=True)) and any(edits)
    same = lines.letter_pairs(pa.array(["  A b,c9 ", "a b c0", "", " .", None]))
    assert (same[0] == same[1]).all() and not same[2:].any()
    words = [" ".join("".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(20)) for _ in range(200)]
    x = lines.letter_pairs(pa.array(words))
    far = np.unpackbits((x[1:] ^ x[:-1]).view(np.uint8), axis=1).sum(axis=1)
    assert (far > 4 * 0.1 * 119).mean() > 0.99


def test_edit_distance():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        d, most = slow_distance(a, b), r.randint(0, 14)
        assert lines.edit_distance(a, b, most) == (d if d <= most else None)


def test_lines_that_occur_once_are_not_sent_again(spark, monkeypatch):
    """Only lines that repeat or have near copies look for their first occurrence."""
    kept, keep = {}, common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    monkeypatch.setattr(common.Scratch, "drop", lambda self: None)
    near = "the quick brown fox jumps over the lazy dog near the old stone bridge"
    texts = ["one alone\nshort", f"{near}\nshort", f"{near}s\ntwo", "three alone\nfour", f"{near}s"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lines.kept_text for r in lines.remove_repeated_lines(rows).collect()}
    assert got == {0: "one alone\nshort", 1: near, 2: "two", 3: "three alone\nfour", 4: ""}
    assert kept["line-nodes"].count() == 7 and kept["line-firsts"].count() == 3
    members = [(r.v, r.node) for r in kept["list-members"].collect()]
    assert len(set(members)) == len(members)


def test_lines_with_a_changed_sign_are_found(spark):
    """Of pairs of lines of 5 to 80 words that differ in one sign nine in ten are linked at least."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows, of = [], {}
    for n in (5, 6, 7, 8, 12, 13, 20, 24, 25, 40, 49, 50, 80):
        for _ in range(40):
            line = " ".join(r.choice(vocab) for _ in range(n))
            i = r.randrange(len(line))
            other = line[:i] + r.choice([r.choice("xyz"), "", "q" + line[i]]) + line[i + 1 :]
            of[len(rows) + 1] = n
            rows += [(len(rows), line), (len(rows) + 1, other)]
    got = {x.doc_id: x.lines.n_removed for x in lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[d] for d, _ in rows if d % 2 == 0)
    share = {n: np.mean([got[d] for d in of if of[d] == n]) for n in set(of.values())}
    assert min(share.values()) >= 0.8 and np.mean([*share.values()]) >= 0.95


def test_lines_of_rows_that_share_a_doc_id(spark):
    one, two, long = "one line that both of the rows hold here", "a unique line that stands nowhere else at all", "w " * 60_000
    rows = [(2, one), (2, f"{one}\n{two}"), (2, f"{one}\n{two}"), (3, f"{long}\n{two}"), (4, long), (4, None)]
    got = lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("clash"))).collect()
    kept = sorted((r.doc_id, r.lines.kept_text) for r in got)
    assert [k for k in kept if k[0] > 2] == [(3, long), (4, ""), (4, "")]
    assert sorted(k[1].count(one) for k in kept if k[0] == 2) in ([0, 0, 1], [0, 1, 1]) and sum(two in k[1] for k in kept) == 2


# --- licences ---


def test_licences(spark, empty):
    bsd = [licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    rows = [
        (1, "Some text\nLicensed under the Apache License, Version 2.0."), (2, ". ".join(bsd) + "."), (3, ". ".join(reversed(bsd))),
        (4, ". ".join([*bsd, licences.SENTENCES["bsd-endorse"]])), (5, None), (6, ""), (7, "the licence of nothing"), (8, "x" * 100_000),
        (9, "Permission is hereby granted, free of charge,\n to any person " + licences.SENTENCES["mit-grant"].split("to any person ")[1] + ":\n\n" + licences.SENTENCES["mit-include"] + "."),
        (10, "SPDX-License-Identifier: MIT"),
    ]
    got = {r.doc_id: r.licence.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", F.lit(1))).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["BSD-2-Clause"], 3: [], 4: ["BSD-3-Clause"], 5: [], 6: [], 7: [], 8: [], 9: ["MIT"], 10: ["MIT"]}
    assert licences.scan(empty).count() == 0


def test_whole_licence_headers(spark):
    apache = """Copyright 2020 A B

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    mit = licences.SENTENCES["mit-grant"].replace(" files ", "\nfiles ") + ":\n\n" + licences.SENTENCES["mit-include"] + ".\n\nOther parts\nLicensed under the BSD License\nend"
    gpl = licences.SENTENCES["gpl-terms-2"].replace("Foundation; ", "Foundation;\n") + "."
    df = spark.createDataFrame([(1, apache), (2, mit), (3, gpl), (4, apache.replace("\n", "\r\n"))], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [got[k].licences for k in (1, 2, 3, 4)] == [["Apache-2.0"], ["BSD", "MIT"], ["GPL-2.0"], ["Apache-2.0"]]
    assert got[1].sentence_ids == got[4].sentence_ids == ["apache-header", "apache-use", "apache-copy", "apache-asis", "apache-see"]
    assert got[2].sentence_ids == ["mit-grant", "mit-include", "bsd-notice"]


LICENCE_TEXTS = ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0")


@pytest.mark.skipif(not all(os.path.exists(f"/usr/share/common-licenses/{x}") for x in LICENCE_TEXTS), reason="no licence texts")
def test_whole_licence_texts(spark):
    rows = []
    for k, name in enumerate(LICENCE_TEXTS):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            rows.append((k, "before it\n\n" + f.read() + "\nafter it"))
    rows += [(10, "zlib\n\nThis software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n1.")] * 2
    got = {r.doc_id: r.licence.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == ["Zlib"]
    for k, want in enumerate(("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")):
        assert want in got[k], (want, got[k])


def test_known_sentences_have_a_telling_word():
    assert all(re.search(licences.TELLING, licences.normalised(s)) for s in licences.SENTENCES.values())


# --- substrings ---


@pytest.mark.parametrize("cells", [2**25, 2**16])
def test_substrings(spark, docs, empty, cells):
    rows = corpus()
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    got = {r.doc_id: r.dedup for r in substrings.remove_repeats(docs.withColumn("dedup", F.lit(0)), most_cells=cells).collect()}
    for d, ws in words.items():
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - 49):
            if first[tuple(ws[i : i + 50])] < d:
                gone[i : i + 50] = True
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_text) == (len(ws), gone.sum(), kept)
    assert substrings.remove_repeats(empty).count() == 0


# --- neighbours ---


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[700:760] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0] * 3), (5400, [])]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1200, 100))
    d64, hits = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want))
    assert hits / 120 >= 0.95
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few.collect()) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- decontamination ---


def test_decontamination(spark, empty):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(30) + ". " + say(8)) for i in range(12)] + [(50, None), (51, ""), (52, say(150))]
    docs = [(i, say(r.choice([3, 200, 600]))) for i in range(150)]
    want = set()
    for k, (i, t) in enumerate(items[:12]):
        docs.append((1000 + k, say(300) + " " + t + " " + say(100)))
        words = t.split()
        for _ in range(5):
            words[r.randrange(25)] = r.choice(vocab)
        docs.append((2000 + k, say(90) + " " + " ".join(words).upper() + " " + say(90)))
        want |= {(1000 + k, i), (2000 + k, i)}
    docs += [(3000, items[14][1]), (3001, None), (3002, "")]
    want.add((3000, 52))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontaminate.without_contaminated(table, bench).count() == len(docs) - 25
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_decontamination_of_common_words(spark):
    """Copies in a third of all rows, a quarter or two fifths of their words replaced: what they kept is common."""
    r = random.Random(16)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(f"item{i}x{k}" for k in range(30)) + ". " + " ".join(f"answer{i}x{k}" for k in range(6))) for i in range(40)]
    docs = [(i, " ".join(say(r.choice([3, 200, 700])))) for i in range(60)]
    for item, gone in ((2, range(0, 27, 3)), (7, range(0, 28, 2))):
        copy = items[item][1].split()
        for k in gone:
            copy[k] = f"other{k}"
        docs += [(1000 * item + i, " ".join(say(r.choice([0, 90, 900])) + copy + say(r.choice([0, 60, 500])))) for i in range(30)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table, bench).collect()
    hits = sorted((x.doc_id, x.item_id) for x in got)
    assert hits == [(1000 * item + i, item) for item in (2, 7) for i in range(30)]


def test_overlap_misses_nothing():
    """Every passage whose region has a subsequence long enough is a candidate."""
    r = random.Random(17)
    some = lambda n: np.array([r.randrange(30) for _ in range(n)], int)
    items, texts = [some(n) for n in (1, 5, 12, 40, 150)], [some(n) for n in (0, 1, 64, 65, 200, 900)]
    texts += [np.concatenate([some(300), items[4], some(70)]), np.concatenate([items[3][:20], some(400), items[3]])]
    overlap, step, size = decontaminate.Overlap(items, 0.5, 30), decontaminate.STEP, decontaminate.PASSAGE
    got = {tuple(x) for x in overlap.candidates(np.concatenate(texts), np.cumsum([0, *map(len, texts)])).tolist()}
    for d, t in enumerate(texts):
        for q, want in enumerate(items):
            for p in range(max(0, -(-(len(t) - size) // step)) + 1):
                region = t[max(0, p * step - len(want)) : p * step + size + len(want)]
                if decontaminate.common_subsequence(want.tolist(), region.tolist()) * 2 >= len(want):
                    assert (d, q, p) in got


def test_subsequences_side_by_side():
    r = random.Random(18)
    some = lambda n: np.array([r.randrange(12) for _ in range(n)])
    items, ids = [some(n) for n in (1, 7, 63, 64, 65, 130)], np.array([r.randrange(13) for _ in range(900)])
    tool = decontaminate.Sequences(items, 12)
    ask = [(r.randrange(6), a, min(900, a + r.randrange(0, 300))) for a in (r.randrange(900) for _ in range(300))]
    which, start, stop = (np.array(x) for x in zip(*ask, strict=True))
    got = tool.common(which, ids, start, stop).tolist()
    assert got == [decontaminate.common_subsequence(items[q].tolist(), ids[a:b].tolist()) for q, a, b in ask]


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(8)
    for _ in range(100):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 30))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == slow(a, b)


# --- odd rows ---


def test_long_turns(spark):
    long = "</s>x [INST] " * 100_000
    got = chat.read_back(chat.format_conversations(spark.createDataFrame([(6, 0, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert (got.loss_chars, got.loss_sha256) == (len(long), hashlib.sha256(long.encode()).hexdigest()) and got.formatted_chars == len(long) + 200_000 + 7


def test_wrong_masks_are_seen(spark):
    """The loss is what the mask cuts out of the text, not what the turns say."""
    rows = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "cdef")], "conv_id long, turn long, role string, text string")
    shifted = chat.format_conversations(rows).withColumn("loss_start", F.col("loss_start") + 1)
    assert chat.read_back(chat.in_order(shifted)).first().loss_sha256 != hashlib.sha256(b"cdef").hexdigest()


def test_quality_of_odd_rows(spark):
    rows = [(i, "the river and the house of " * 20) for i in range(40)] + [(i, "$$ THE!! | #### " * 20) for i in range(40, 80)]
    table = spark.createDataFrame([*rows, *rows[:3], (None, "x"), (99, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    scored = quality.score(table, quality.fit(table, labels)).collect()
    assert len(scored) == 85 and all(0 <= r.score <= 1 for r in scored)
    assert min(r.score for r in scored if r.doc_id is not None and 3 < r.doc_id < 40) > 0.5 > max(r.score for r in scored if r.doc_id is not None and 40 <= r.doc_id < 80)


def test_mixing_repeated_rows(spark, docs):
    twice = docs.union(docs).withColumn("mix", F.lit("clash"))
    one, two = ({(r.doc_id, r.mix.taken, r.mix.source_size) for r in mixing.mix(x).collect()} for x in (twice, twice.repartition(3)))
    assert one == two and mixing.mix(twice).count() == 2 * docs.count() and mixing.mix(twice).columns == twice.columns


def test_tokens_of_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(None, "b a"), (None, "a b"), (3, "same"), (3, "same"), (3, None), (1, "one two")]
    tokens.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/out", vocabulary())
    got = tokens.read(spark, f"file://{tmp_path}/out").orderBy("start").collect()
    t = Tokenizer.from_file(vocabulary())
    want = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [(r.doc_id, r.ids) for r in got] == want and [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want[:-1])]).tolist()


def test_substrings_of_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(5, passage), (5, f"other {passage}"), (None, passage), (7, f"{passage} tail")]
    got = [(r.doc_id, r.dedup.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(5, 0), (5, 0), (7, 60), (None, 60)]


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert {v for *_, v in got} == {1, 2} and all(q == 0 for q, *_ in got)


def test_decontamination_of_many_items(spark):
    """More items than a block holds; all documents against all items by plain subsequences."""
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(2500)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(24)) + ". " + " ".join(say(6))) for i in range(401)]
    docs = [(i, " ".join(say(300))) for i in range(40)] + [(900, " ".join(say(30_000)) + " " + items[399][1])]
    for k, i in enumerate((0, 199, 200, 201, 400)):
        words = items[i][1].split()
        for at in r.sample(range(20), 6):
            words[at] = r.choice(vocab)
        docs.append((500 + k, " ".join(say(100) + words + say(100))))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("cosine", F.lit("clash"))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    wants = [(i, [*t.replace(".", "").split()]) for i, t in items]
    for d, t in docs[:-6] + docs[-5:]:
        ws = t.replace(".", "").split()
        want |= {(d, i) for i, x in wants if decontaminate.common_subsequence(x, ws) >= 0.7 * len(x)}
    assert {(d, i) for d, i in got if d != 900} == want and (900, 399) in got and len(want) == 5
