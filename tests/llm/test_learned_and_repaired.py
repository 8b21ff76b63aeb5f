"""Conversation repair, toxicity and spelling variants, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD_ROWS
from tidemark.llm import conversation_repair, registry, spelling_variants, toxicity

# --- conversation repair

def fits(roles):
    """Whether role initials are (s?(ua)+)?."""
    rest = roles[1:] if roles.startswith("s") else roles
    return not roles or (len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def all_edits(signature, slack):
    """(cost, audit) of all edits with so many insertions at most that give valid roles."""
    def go(i, left, cost, audit, roles):
        if i == len(signature) and fits(roles):
            yield cost, audit
        if left:
            for r in "ua":
                yield from go(i, left - 1, cost + 5, audit + "I", roles + r)
        if i < len(signature):
            x = signature[i]
            yield from go(i + 1, left, cost + 2, audit + "D", roles)
            if x != "x":
                cut = 5 if x.isupper() else 0
                if x.lower() in "sua":
                    yield from go(i + 1, left, cost + cut, audit + "K", roles + x.lower())
                for r in "ua":
                    yield from go(i + 1, left, cost + cut + 1, audit + "R", roles + r)

    return go(0, slack, 0, "", "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="suaoSUAx", max_size=5))
def test_solutions_equal_all_edits(signature):
    assert conversation_repair.solve(signature) == min(all_edits(signature, 2))


def test_long_signatures_need_no_depth():
    assert conversation_repair.solve("su" + "ua" * 30_000 + "x") == (4, "KD" + "K" * 60_000 + "D")


def plain_report(rows):
    """The report of one conversation's rows (turn, role, text), by the words of the definition."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    space = " \t\n\x0b\x0c\r"
    seen, marks, count = set(), [], Counter()
    for _, role, text in rows:
        last = text.rstrip(space)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        count[fault] += 1
        initial = role[:1] if role[:1] in "sua" and role else "o"
        marks.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
    roles = [r[1][:1] for r in rows]
    count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = conversation_repair.solve("".join(marks))
    out, i = [], 0
    for e in audit:
        turn = "assistant" if out and out[-1].startswith("u") else "user"
        if e == "I":
            out.append(f"{turn}:")
            continue
        _, role, text = rows[i]
        i += 1
        if e != "D":
            out.append(f"{role if e == 'K' else turn}:{text}")
    return gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_reports_equal_the_definition(spark):
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "superuser"]
    texts = ["Hi.", "Hi", "No!", "  ", "", None, "Why?\n ", "a\u0085", "Hi.\u2028", "é.", "x" * 50_000 + ".", "." * 3]
    convs = {}
    for c in [*range(120), None]:
        convs[c] = [(draw.choice([None, 0, 1, 2, 3, 5, 9]), draw.choice(roles), draw.choice(texts)) for _ in range(draw.randint(1, 7))]
    convs[500] = [(i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(3_001)]
    rows = [(c, *r, 1, "s") for c, own in convs.items() for r in own]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, signature string").repartition(3)
    found = {r.conv_id: tuple(r[f] for f in FIELDS) for r in conversation_repair.repair_report(table).collect()}
    assert found == {c: plain_report(own) for c, own in convs.items()}
    none = conversation_repair.repair_report(table.limit(0))
    assert none.count() == 0 and none.columns == ["conv_id", *FIELDS]


def test_damage_and_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    convs = defaultdict(list)
    for c, t, role, text in rows:
        own, text = convs[c], " " if text is None else text
        draw = zlib.crc32(f"{c}:{t}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else text.translate({ord(x): None for x in ".!?"}) if draw == 2 else text
        own += [(t, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    found = {r.conv_id: tuple(r[f] for f in FIELDS) for r in registry.op11_conversation_repair(spark, small).collect()}
    assert found == {c: plain_report(own) for c, own in convs.items()}


def test_damage_of_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None, "x"), (7, None, "user", "a.", "x")], "conv_id long, turn long, role string, text string, copy string")
    kinds = [zlib.crc32(k) % 20 for k in (b" : ", b"7: ")]
    got = conversation_repair.damaged(rows).orderBy("conv_id").collect()
    assert len(got) == 2 + kinds.count(3) and not set(kinds) & {0}
    assert got[0].role in (" ", "user") and got[0].text in (" ", "")


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be good."), (1, 1, "user", "Hi."), (1, 2, "user", "There."), (1, 3, "tool", "Yes."), (2, 0, "user", "Hm")],
                                 "conv_id long, turn long, role string, text string")
    found = conversation_repair.audits(rows)
    got = [tuple(r) for r in conversation_repair.repaired(rows, found).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", 0, "system", "Be good."), (1, 1, "K", 2, "user", "There."), (1, 2, "R", 3, "assistant", "Yes.")]
    assert {r.conv_id: r.audit for r in found.collect()} == {1: "KDKR", 2: "D"}


# --- toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.op12_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    toxic = [r for r in rows if r.toxic == 1 and r.quality == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_pairs_count_for_more_than_their_weights(spark):
    """Each of two words is harmless alone; together they are not."""
    draw = random.Random(1)
    texts = []
    for i in range(1_500):
        words = [draw.choice("river stone cloud table lamp chair".split()) for _ in range(8)]
        marks = draw.choice([(), ("badword",), ("somegroup",), ("badword", "somegroup")])
        texts.append((i, " ".join([*words, *marks]), int(len(marks) == 2)))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    score = model.scorer()
    assert score("river badword somegroup") > 0.8 and score("lamp badword") < 0.3 and score("somegroup table") < 0.3
    slots = [int(np.searchsorted(model.kept, toxicity.buckets_of(w)[0])) for w in ("badword", "somegroup")]
    assert model.vectors[slots[0]] @ model.vectors[slots[1]] > 0.1
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(abs(found[i].score - score(t)) < 1e-9 and found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, t, _ in texts)


def test_scores_equal_all_pairs():
    draw = np.random.default_rng(3)
    texts = ["", "one", "Alpha beta alpha", "alphabet soup", "beta gamma delta epsilon"]
    kept = np.array(sorted({b for t in texts[1:] for b in toxicity.terms(t)})[::2])
    model = toxicity.ToxicityModel(kept, 0.3, draw.normal(size=len(kept)), draw.normal(size=(len(kept), toxicity.FACTORS)))
    place = {int(b): k for k, b in enumerate(kept)}
    for t in texts:
        slots = [place[b] for b in toxicity.terms(t) if b in place]
        z = model.bias + sum(model.weights[s] for s in slots)
        z += sum(model.vectors[a] @ model.vectors[b] for i, a in enumerate(slots) for b in slots[i + 1 :])
        assert abs(model.scorer()(t) - 1 / (1 + np.exp(-z))) < 1e-12
        assert abs(model.margins(np.array(slots, np.int64), np.array([0, len(slots)]))[0] - z) < 1e-12


def test_steps_go_down_the_slope(monkeypatch):
    """One step on one batch moves each parameter against the slope of the loss, as differences say."""
    draw = np.random.default_rng(4)
    n = 6
    model = toxicity.ToxicityModel(np.arange(n), 0.1, draw.normal(size=n), draw.normal(size=(n, toxicity.FACTORS)))
    texts, y = [[0, 1, 2], [1, 3], [2, 3, 4]], np.array([1.0, 0.0, 1.0])
    slots, sizes = np.concatenate(texts), np.array([len(t) for t in texts])

    def loss(m):
        z = m.margins(slots, np.concatenate([[0], np.cumsum(sizes)]))
        return np.mean(np.log1p(np.exp(z)) - y * z) + toxicity.PENALTY / 2 * ((m.weights[:5] ** 2).sum() + (m.vectors[:5] ** 2).sum())

    monkeypatch.setattr(toxicity, "PASSES", 1)
    after = toxicity.trained(model, slots, sizes, y, 0)
    for name in ("weights", "vectors"):
        here = getattr(model, name)
        for at in np.ndindex(here.shape):
            moved = here.copy()
            moved[at] += 1e-6
            slope = (loss(toxicity.replace(model, **{name: moved})) - loss(model)) / 1e-6
            step = getattr(after, name)[at] - here[at]
            assert abs(step + toxicity.STEP * slope / np.sqrt(1e-6 + slope**2)) < 1e-3


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score < 1e-9 for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {True}
    assert {r.predicted for r in toxicity.score_toxicity(odd, labels.where("toxic = 1")).collect()} == {1}
    assert toxicity.score_toxicity(none, labels).count() == 0


# --- spelling variants

def near(a, b):
    """Whether two words differ by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    return {w: (f, root_of(out, w), n, k, m) for w, (f, n, k, m) in out.items()}


def root_of(out, w):
    while out[w][0] is not None:
        w = out[w][0]
    return w


def made_docs(spark, counts):
    words = [w for w, n in counts.items() for _ in range(n)]
    random.Random(2).shuffle(words)
    return spark.createDataFrame([(i, " ".join(words[i::17])) for i in range(17)], "doc_id long, text string")


@pytest.mark.parametrize(("letters", "longest"), [("ab", 8), ("abcé", 6), ("aÿ÷", 7)])
def test_variants_equal_all_pairs(spark, letters, longest):
    """Few letters make many near words, long runs of one letter, and words that begin others."""
    draw = random.Random(longest)
    counts = {}
    for _ in range(400):
        counts["".join(draw.choice(letters) for _ in range(draw.randint(5, longest)))] = draw.choice([3, 4, 6, 7, 12, 13, 30, 60])
    counts |= {"a" * n: 3 * 2 ** (n - 5) for n in range(5, 10)}
    got = spelling_variants.spelling_variants(made_docs(spark, counts), damage=0).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(counts)


def test_words_of_texts(spark):
    docs = spark.createDataFrame([(1, "Hello, HELLO hello-World world"), (2, "WORLD hellO ÀÉÎõ ÀÉÎõÜ àéîõü ÀÉÎõÜ"), (3, None), (None, "hello"), (4, ""), (4, "ÀÉÎõÜ")],
                                 "doc_id long, text string")
    got = {r.word: r.n for r in spelling_variants.word_counts(docs, damage=0).collect()}
    assert got == {"hello": 5, "world": 3, "ÀÉÎõÜ": 3}


def test_letters_are_lost_by_hash(spark):
    docs = [(i, "spelling") for i in range(3_000)]
    lost = Counter()
    for i, w in docs:
        h = zlib.crc32(f"{i}:{w}".encode())
        lost[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    got = {r.word: r.n for r in spelling_variants.word_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {w: n for w, n in lost.items() if n >= 3}


def test_variants_odd_rows(spark, odd, none):
    got = {r.word: r for r in spelling_variants.spelling_variants(odd, damage=0).collect()}
    assert {"quick", "brown", "jumps"} <= set(got) and got["quick"].n == 4 and got["quick"].root == "quick"
    assert spelling_variants.spelling_variants(none).count() == 0
    long = spark.createDataFrame([(i, "ab" * 1_000 + ("x" if i < 9 else "")) for i in range(12)], "doc_id long, text string")
    got = {len(r.word): r for r in spelling_variants.spelling_variants(long, damage=0).collect()}
    assert (got[2000].form, got[2001].n_near, got[2000].form_n) == ("ab" * 1_000 + "x", 1, 9)
