"""Corpus operators against plain Python on small tables, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docframe.llm import components, decontaminate, hmm, jaccard_join, language_id, line_dedup, mixing, pii, quality_rules, substring_dedup, token_counts
from docframe.llm.queries import QUERIES, vocabulary_path
from docframe.plans.ship import ship

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns named like outputs."""
    ship(spark)
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None, "x", "y"), (2, "", None, None, 0, None, None), (None, "only me here", None, "b", 3, None, None),
        (3, long, "en", "a", 1, None, None), (4, "one two three four five six", "de", None, 1, None, None),
        (4, "one two three four five six", "de", None, 1, None, None), (4, "other text", "de", "a", 1, None, None),
        (None, None, None, None, None, None, None), (5, " \t\n ", "en", "c", 1, None, None), (6, "l1 a\nl2 b\nl3 c\nl4 d", "en", "a", 1, None, None),
        (7, "l1 a\nl2 b\nl3 c\nx", "en", "a", 1, None, None), (8, long, "en", "a", 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def words(text):
    return (text or "").encode().split()


def test_token_counts_match_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rows = token_counts.count_tokens(docs.select("doc_id", "text"), vocabulary_path()).collect()
    assert all(r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) for r in rows)
    count = token_counts.counter(open(vocabulary_path(), "rb").read())
    rng = random.Random(3)
    chars = "ab 1'sé\n\t<|endoftext|>　՘\U0001f600中́."
    for text in ["", "<|endoftext|>", "a<|endoftext|> b", "'ll 'LL", *["".join(rng.choices(chars, k=30)) for _ in range(300)]]:
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert {r.n_tokens for r in token_counts.count_tokens(odd, vocabulary_path()).filter("text IS NULL").collect()} == {0}


def base_spans(text):
    """The four base rules, written plainly."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def test_base_personal_data(spark, docs, odd):
    rng = random.Random(5)
    pieces = ["a.b@c.d", "@@x.y", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
              "+12", " ", "_z@q.r", "é", "00123", ".", "-", "+49.30.1234567", "a_b@c.de.f@g.h"]
    made = ["".join(rng.choices(pieces, k=6)) for _ in range(500)] + ["9" * 50_000 + " " + "a" * 50_000]
    for text in made + [r.text for r in docs.collect()]:
        found = pii.matches(text)
        assert sorted(x[:3] for x in found if x[3] == 1) == base_spans(text), text
    rows = pii.find_personal_data(docs.select("doc_id", "text")).collect()
    want = texts_of(docs)
    assert all([tuple(x)[:3] for x in r.found if x.base] == base_spans(want[r.doc_id]) for r in rows)
    assert pii.find_personal_data(odd.select("doc_id", "text")).count() == odd.count()


def test_reliabilities_follow_agreement():
    yes, no = sum(2 * 3**i for i in range(5)), 0
    p = pii.reliabilities({yes: 80, no: 60, yes - 2: 5})
    assert p[yes] > 0.95 and p[no] < 0.05 and p[yes - 2] > 0.5


def test_lines_and_passages_edge_cases(odd, empty):
    lines = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(odd).collect()}
    assert (6, "l1 a\nl2 b\nl3 c\nl4 d", 0) in lines and (7, "x", 3) in lines and (5, " \t\n ", 0) in lines and (1, None, 0) in lines
    rows = substring_dedup.dedup_passages(odd).collect()
    by = {(r.doc_id, r.n_words, r.n_removed) for r in rows}
    assert (3, 30_000, 0) in by and (8, 30_000, 30_000) in by and (1, 0, 0) in by and len(rows) == odd.count()
    for fn in (line_dedup.dedup_lines, substring_dedup.dedup_passages):
        assert fn(empty).count() == 0


def passages(texts, width):
    first, out = {}, {}
    split = {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k : k + width]), i)
    for i, w in split.items():
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
    return out


@pytest.mark.parametrize("width,gram", [(3, 2), (5, 2), (8, 3)])
def test_passages_by_brute_force(spark, width, gram):
    ship(spark)
    rng = random.Random(width)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.randint(2, 12))) for _ in range(6)]
    texts = {i: " ".join(rng.choice(shared) if rng.random() < 0.6 else rng.choice("stuvwxyz") for _ in range(rng.randint(0, 12))) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert texts_of(substring_dedup.dedup_passages(df, width=width, gram=gram)) == passages(texts, width)


def shingles(text, width):
    w = [x.lower() if x.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in words(text)]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    return [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def lowest(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def near_copies(seed, n=90):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(20, 60))] for _ in range(5)]
    out = {}
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.9 else [str(rng.random()) for _ in range(20)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        out[i] = " ".join(w)
    out[n], out[n + 1], out[n + 2] = "", "solo", "SOLO"
    return out


@pytest.mark.parametrize("width,percent,spare", [(3, 90, 4), (5, 80, 4), (2, 60, 4), (5, 80, 16), (2, 60, 1)])
def test_jaccard_components_and_links(spark, width, percent, spare):
    ship(spark)
    texts = near_copies(width)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = lowest(texts, linked(texts, width, percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, width=width, percent=percent, spare=spare).collect()}
    assert got == {i: (len(shingles(t, width)), want[i]) for i, t in texts.items()}
    links, members = jaccard_join.jaccard_links(df, width=width, percent=percent, spare=spare)
    of = {r.doc_id: r.cid for r in members.collect()}
    have = {(r.a, r.b) for r in links.collect()}
    assert have == {tuple(sorted((of[a], of[b]))) for a, b in linked(texts, width, percent) if of[a] != of[b]}


def test_jaccard_edge_cases(odd, empty):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == odd.count() and jaccard_join.jaccard_components(empty).count() == 0
    assert {r.component_id for r in got if r.doc_id == 8} == {3}
    kept = jaccard_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and ids[8] == 0 and ids[4] == 2 and ids[1] == ids[2] == ids[5] == 1 and ids[None] == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 560)]
    nodes = {x for e in edges for x in e}
    want = lowest(nodes, edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def test_decontamination(spark, odd, empty):
    rng = random.Random(2)
    items = {i: " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randint(3, 60))) for i in range(40)}
    texts = {}
    for d in range(60):
        w = [f"z{rng.randrange(900)}" for _ in range(rng.randint(0, 300))]
        if rng.random() < 0.7:
            own = rng.choice(list(items.values())).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = "x"
            w[len(w) // 2 : len(w) // 2] = own
        texts[d] = "\n ".join(w)
    a, b = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = set()
    for d, t in texts.items():
        for i, s in items.items():
            held, asked = shingles(t, 5), shingles(s, 5)
            if len(s.split()) >= 5 and len(held & asked) >= 0.8 * len(asked) - 1e-9:
                want.add((d, i, len(held & asked), len(asked)))
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(a, b).collect()} == want and want
    assert {r.doc_id for r in decontaminate.drop_contaminated(a, b).collect()} == set(texts) - {w[0] for w in want}
    assert decontaminate.contaminated(empty, b).count() == 0 and decontaminate.drop_contaminated(odd, b.limit(0)).count() == odd.count()


def test_mixing_edge_cases(odd, empty):
    sized = odd.withColumn("size", mixing.n_words("text"))
    rows = mixing.mix_sources(sized).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    per = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in per.values()) == pytest.approx(1.5 * sum(s for s, _ in per.values()))
    assert all(t <= 2 * s + 1e-9 for s, t in per.values())
    assert mixing.mix_sources(empty.withColumn("size", F.lit(1))).count() == 0


def test_hidden_markov_scores(spark, docs, odd, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = hmm.score_texts(docs, held, states=4, rounds=3).collect()
    low = {i: [x.lower() for x in words(t)] + [None] for i, t in texts_of(docs).items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in low}
    c = Counter(x for i, w in low.items() if not out[i] for x in w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[r.doc_id], len(low[r.doc_id]), n)
        assert r.n_known == sum(c[x] > 0 for x in low[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in low[r.doc_id]))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert hmm.score_texts(odd, F.lit(False)).count() == odd.count() and hmm.score_texts(empty, F.lit(False)).count() == 0


def test_forward_and_expected_counts_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = hmm.Model.from_counts(rng.random(2), rng.random((2, 2)), rng.random((3, 2)))
    seqs = [[0, 1, 2, 1], [2], [1, 1, 0]]
    flat, first = np.array(sum(seqs, [])), np.cumsum([0] + [len(s) for s in seqs])
    padded = np.array([s + [-1] * (4 - len(s)) for s in seqs])
    start, move, emit = model.expected(padded)
    w_start, w_move, w_emit, logs = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), []
    for s in seqs:
        paths = {p: model.start[p[0]] * math.prod(model.emit[o, k] for o, k in zip(s, p)) * math.prod(model.move[a, b] for a, b in zip(p, p[1:]))
                 for p in itertools.product(range(2), repeat=len(s))}
        total = sum(paths.values())
        logs.append(math.log(total))
        for p, q in paths.items():
            w_start[p[0]] += q / total
            for o, k in zip(s, p):
                w_emit[o, k] += q / total
            for a, b in zip(p, p[1:]):
                w_move[a, b] += q / total
    assert np.allclose(model.log_likelihood(flat, first), logs)
    assert np.allclose(start, w_start) and np.allclose(move, w_move) and np.allclose(emit, w_emit)


def test_language_held_out_accuracy(spark, docs, odd, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language_id.fit(docs.filter(~held))
    rows = language_id.predict_languages(docs.filter(held), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    got = language_id.predict_languages(odd, model).collect()
    assert {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"} and all(0 <= r.score <= 1 for r in got)
    nothing = language_id.predict_languages(odd, language_id.fit(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_quality_counts_and_cutoffs(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(4)
    made = {i: "".join(rng.choices(["a b", "\n", " ", "#x", "é|", "q w e r t y u i ", "a b\n"], k=rng.randint(0, 60))) for i in range(150)}
    extra = spark.createDataFrame([(i, t, "en") for i, t in made.items()], "doc_id long, text string, lang string")
    both = {**made, **{i + 1000: t for i, t in texts_of(docs).items()}}
    df = extra.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang"))
    for r in quality_rules.judge(df, labels).collect():
        t = both[r.doc_id]
        w = words(t)
        lines = [x for x in t.split("\n") if x.encode().split()]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(odd, labels).count() == odd.count() and quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.binomial_tail(2, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)))
    import numpy as np

    good = np.zeros(quality_rules.BINS)
    good[0], good[40], good[10] = 5000, 10, 400
    assert 10 < quality_rules.safe_cutoff(good, 0.01, 0.001) <= 40 and quality_rules.safe_cutoff(good / 1000, 0.01, 0.001) == quality_rules.BINS


def test_pipeline_stages_by_brute_force(spark, docs):
    rows = docs.collect()
    model = language_id.fit(docs)
    kept = [r for r, (lang, score) in zip(rows, model.predict([r.text for r in rows])) if lang != "und" and score >= 0.5]
    one = corpus_pipeline.known_language(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in kept} and one.columns == docs.columns
    texts, first = {}, {}
    for r in sorted(kept):
        lines = r.text.split("\n")
        full = [i for i, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for k in range(len(full) - 2):
            key = tuple(lines[i] for i in full[k : k + 3])
            if first.setdefault(key, (r.doc_id, k)) != (r.doc_id, k):
                gone.update(full[k : k + 3])
        texts[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    two = corpus_pipeline.without_repeated_lines(spark, one, SF)
    assert texts_of(two) == texts
    root = lowest(texts, linked(texts, 5, 80))
    stay = {i for i in texts if root[i] == i}
    three = corpus_pipeline.without_near_copies(spark, two, SF)
    assert {r.doc_id for r in three.collect()} == stay
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 5]
    clean = {i for i in stay if not any(len(shingles(texts[i], 5) & s) >= 0.8 * len(s) - 1e-9 for s in items)}
    four = corpus_pipeline.without_benchmark(spark, three, SF)
    assert {r.doc_id for r in four.collect()} == clean
    five = corpus_pipeline.mixed(spark, four, SF).collect()
    assert {r.doc_id: r.size for r in five} == {i: len(words(texts[i])) for i in clean}
    assert sum(r.taken for r in five) == pytest.approx(1.5 * sum(r.size for r in five), rel=0.1)


def test_queries_and_hashes(spark):
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 11)]
    row = QUERIES["op2_personal_data"](spark, SF).filter("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
