import itertools
from collections import Counter

import numpy as np

from candlewick.llm import chat_format as cf


def model():
    emitted, moved = Counter(), Counter()
    rng = np.random.default_rng(1)
    for _ in range(300):
        role = int(rng.integers(3))
        emitted[tuple(cf.features(-1, role == 0, True, "x" * int(rng.integers(1, 10 * (1 + 9 * role)))) ), role] += 1
        moved[int(rng.integers(4)), role] += 1
    return cf.Model(emitted, moved)


def test_viterbi_equals_all_paths():
    m = model()
    xs = [cf.features(k - 1, not i, True, "y" * n) for i, (k, n) in enumerate([(0, 3), (0, 50), (2, 9), (0, 70), (0, 4)])]

    def score(path):
        return m.start(xs[0])[path[0]] + sum(m.step(x)[a, b] for x, a, b in zip(xs[1:], path, path[1:]))

    best = max(itertools.product(range(3), repeat=len(xs)), key=score)
    assert tuple(cf.viterbi(m, xs, None, None)) == best


def test_segments():
    assert cf.segments(None) == [(-1, "")]
    assert cf.segments("What is it?\nA: this") == [(-1, "What is it?"), (2, "this")]
    assert cf.segments("### User:\nhi\n### Assistant\nyes\nno") == [(1, "hi"), (2, "yes\nno")]
    assert cf.segments("a user said so") == [(-1, "a user said so")]
    for plain in ("answer\nis here", "A\nB", "Q", "user\n", "**bot**"):
        assert cf.segments(plain) == [(-1, plain)]
    assert cf.segments("<|system|>be kind\n<|im_start|>user\nhi\n[Bot] yes\n**Human:** go\n## q\nwhy") == [(0, "be kind"), (1, "hi"), (2, "yes"), (1, "go"), (1, "why")]


TRANSCRIPTS = [
    (1, 0, "User: why?\nAssistant: because\nUser: so?\nBot: yes"), (2, 0, "Human: hello"), (2, 1, "AI: hi\nHuman: what?"), (2, 2, "no marker here"), (3, 0, "a plain question?"), (3, 1, "plain words\nQ: and this?\nA: that"),
    (4, 0, "User: once\nAssistant: twice"), (4, 0, "User: once\nAssistant: twice"), (4, 0, "Assistant: another at the same turn"), (None, 0, "system: be kind\nuser: ok"), (5, None, None), (6, 1, ""),
]


def test_transcripts_by_brute_force(spark, monkeypatch):
    seen, train = [], cf.train
    monkeypatch.setattr(cf, "train", lambda rows: seen.append(train(rows)) or seen[-1])
    learnt = [(100 + c, t, "user" if t % 2 == 0 else "assistant", "what is it?" if t % 2 == 0 else "it is " * 20) for c in range(30) for t in range(4)]
    df = spark.createDataFrame([(c, t, None, x) for c, t, x in TRANSCRIPTS] + learnt, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, cf.render(df, 7, 2).where("conv_id < 100 OR conv_id IS NULL").collect()), key=str)
    m, expected = seen[0], []
    rows = df.where("conv_id < 100 OR conv_id IS NULL").selectExpr("conv_id", "turn", "text", "xxhash64(text) AS t1", "xxhash64(1, text) AS t2").collect()
    for conv in {r.conv_id for r in rows}:
        own = sorted({tuple(r) for r in rows if r.conv_id == conv}, key=lambda r: (r[1] is not None, r[1] or 0, r[3], r[4]))
        parts = [(r, k, part, cf.features(marker, r[1] == 0 and not k, not k, part)) for r in own for k, (marker, part) in enumerate(cf.segments(r[2]))]

        def score(path):
            steps = zip(parts[1:], path, path[1:])  # noqa: B023
            return m.start(parts[0][3])[path[0]] + sum(m.step(x[3])[a, b] for x, a, b in steps)  # noqa: B023

        best = max(itertools.product(range(3), repeat=len(parts)), key=score)
        for (r, k, part, _), role in zip(parts, best):
            again = sum(tuple(x) == r for x in rows)
            expected += [(conv, r[1], k, cf.ROLES[role], cf.TEMPLATE.format(role=cf.ROLES[role], text=part))] * again
    assert got == sorted(expected, key=str)
    roles = {(c, t, k): role for c, t, k, role, _ in got}
    assert [roles[1, 0, k] for k in range(4)] == ["user", "assistant"] * 2 and roles[None, 0, 0] == "system"
    # a row that comes twice is decoded once and gives its turns twice
    assert sorted((k, role) for c, t, k, role, x in got if c == 4 and "ce\n" in x) == [(0, "user")] * 2 + [(1, "assistant")] * 2


def test_counts_go_over_blocks_and_partitions(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in (1, 2, 4) for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    models = []
    for parts, block in ((1, 1000), (5, 3)):
        keep = {}
        original = cf.train
        try:
            cf.train = lambda r: keep.setdefault("m", original(r, lambda c: c == 4))  # noqa: B023
            cf.render(df, parts, block).count()
        finally:
            cf.train = original
        models.append(keep["m"])
    assert np.allclose(models[0].moved, models[1].moved) and np.allclose(np.exp(models[0].moved[1, 2]), 51 / 53)


def test_long_texts_and_conversations_span_blocks(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "why?" if t % 2 == 0 else "so it is " * 9) for t in range(300)] + [(2, 0, None, "User: x\nBot: y\n" * 20_000)], "conv_id long, turn long, role string, text string")
    got = cf.render(df, 4, 7).collect()
    assert [r.role for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)] == ["user", "assistant"] * 150
    assert [r.role for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.segment)] == ["user", "assistant"] * 20_000


def test_blocks_change_nothing_and_edges(spark):
    rows = []
    for c in range(40):
        for t in range(1 + c % 9):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, "why?" if role == "user" else "because of " * 30 + "\nthat"))
    rows += [(7, None, None, None), (None, 0, "user", "who?"), (None, 0, "user", "who?"), (99, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", cf.F.lit("x"))
    one, many = (sorted(map(str, cf.render(df, n, b).collect())) for n, b in ((1, 1000), (23, 2)))
    assert one == many and len(one) == len(rows)
    right = sum(f"turn={t}, segment=0, role='{r}'" in "".join(x for x in one if f"conv_id={c}," in x) for c, t, r, _ in rows if r)
    assert right > 0.9 * len(rows)
    assert cf.render(df.limit(0), 3).count() == 0
