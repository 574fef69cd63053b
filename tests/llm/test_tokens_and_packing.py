import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrow.llm import id_store
from harrow.llm.matching_pack import deals, pack, solve
from harrow.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, start int"


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    words = ["the", "été", "don't", "naïve", "1234", "x_y", "漢字", "a b", "\n", "\x1c", "...", "<|endoftext|>", "　", "🙂"]
    rows = [(0, None), (1, ""), (2, " "), (3, "  two  blanks "), (4, "tail\n"), (5, "a\n b"), (6, "word " * 5000)]
    rows += [(i, r.choice([" ", " ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(7, 120)]
    rows += [rows[50], rows[51], (None, "no id"), (50, "another text of an id")]
    r.shuffle(rows)
    return [(*x, "c", 9) for x in rows]


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    t = TOKENIZER
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_added_tokens_are_read_as_the_library_reads_them():
    r = random.Random(11)
    parts = ["<|endoftext|>", "a", " ", "b.", "<|endo", "ftext|>", "  ", "\n", "é", "漢", "|>", "1,"]
    enc = encoder(PATH)
    assert np.frombuffer(enc.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(text)[:-1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs):
    got = pack(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH, capacity=64).collect()
    want = Counter()
    for doc_id, text, *_ in docs:
        ids = ids_of(text)
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        want.update((doc_id, k, s, e - s, crc(ids[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


@pytest.mark.parametrize("seed", range(6))
def test_solution_is_whole_and_near_the_bound(seed):
    r = random.Random(seed)
    sizes = Counter(r.choice([r.randint(1, 100), r.randint(34, 60), r.randint(1, 12)]) for _ in range(r.choice([0, 1, 50, 3000])))
    patterns = solve(dict(sizes), 100)
    used = Counter()
    for n, pattern in patterns:
        assert n > 0 and sum(s * k for s, k in pattern) <= 100
        assert sum(k for s, k in pattern if 3 * s > 100) <= 2
        for s, k in pattern:
            used[s] += n * k
    assert used == sizes
    bound = max(-(-sum(s * n for s, n in sizes.items()) // 100), sum(n for s, n in sizes.items() if 2 * s > 100))
    assert sum(n for n, _ in patterns) <= bound * 1.12 + 2
    assert deals(patterns)[1] == sum(n for n, _ in patterns)


def test_id_store(spark, docs):
    store = id_store.write_ids(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH, shard_bytes=4000)
    assert len(store.shards) > 3
    got = id_store.read_ids(spark, store).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=lambda x: -1 if x is None else x)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids_of(t)), crc(ids_of(t))) for d, t, *_ in docs)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    shard = store.open(0)
    known = [i for i, m in zip(shard.ids.tolist(), shard.marks.tolist()) if m == 0]
    texts = {d: t for d, t, *_ in docs}
    for doc_id in known:
        if doc_id not in (50, None):
            assert shard.get(doc_id).tolist() == ids_of(texts[doc_id])
    assert shard.get(10**12) is None


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        keys = id_store.key_hashes(np.arange(n, dtype=np.int64), np.zeros(n, np.uint64))
        sizes, bits = id_store.build_hash(keys)
        assert sorted(id_store.find(keys, sizes, bits, np.cumsum(bits) - bits).tolist()) == list(range(n))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(none, PATH).count() == 0
    assert id_store.read_ids(spark, id_store.write_ids(none, PATH)).count() == 0
