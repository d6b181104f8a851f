import random
from collections import defaultdict

from tilewright.llm import size_packing
from tilewright.llm.size_packing import SIZES, cost, pack


def check(lengths):
    bins, offsets, sizes = pack(lengths)
    inside = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        inside[b].append((o, n))
    for b, items in inside.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert sizes[b] == min(s for s in SIZES if s >= at)  # cut down to its contents
    assert sorted(inside) == list(range(len(sizes)))
    return sum(cost(s) for s in sizes)


def test_packings_hold_and_are_cheap():
    r = random.Random(1)
    for _ in range(30):
        lengths = [min(8192, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(r.randint(1, 400))]
        assert check(lengths) <= 1.12 * sum(lengths) + cost(SIZES[-1]) + 60 * len(lengths) ** 0.5
    assert check([300, 200, 12]) == cost(512)
    assert check([8192]) == cost(8192)
    assert check([1]) == cost(512)
    assert check([]) == 0


def test_best_fit_never_opens_while_a_bin_has_room():
    bins, _, sizes = pack([500, 480, 30, 12], (512,))
    assert len(sizes) == 2 and bins[0] == bins[3] and bins[1] == bins[2]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(size_packing, "BLOCK_ITEMS", 20)
    rows = [(i, "word " * (37 * i % 900), "x") for i in range(150)] + [(200, None, "x"), (201, "", "y"), (202, "long " * 20_000, ""), (None, "a b", "z"), (5, "same id", ""), (5, "same id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    out = size_packing.pack_documents(df).collect()
    total = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.n_tokens
    assert total[202] == 20_000 and total[None] == 2 and total[200] == total[201] == 0 and total[5] == 37 * 5 + 4
    assert len({r.doc_id for r in out}) == 154 and sum(r.bin is None for r in out) == 3
    inside = defaultdict(list)
    for r in out:
        if r.bin is not None:
            inside[r.block, r.bin, r.bin_size].append((r.bin_offset, r.n_tokens))
    assert len({k[:2] for k in inside}) == len(inside)
    for (_, _, size), items in inside.items():
        ends = [0, *(o + n for o, n in sorted(items))]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= size
    pieces = sorted((r.start, r.n_tokens) for r in out if r.doc_id == 202)
    assert pieces == [(0, 8192), (8192, 8192), (16384, 3616)]
    assert size_packing.pack_documents(df.limit(0)).count() == 0
