import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.data import documents, odd, vocabulary
from waybridge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_hold_every_id_once_without_padding(spark):
    rng, words = random.Random(1), vocabulary(1)
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", "!!", "'s", " 3,5"]) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    texts += odd(rng, words) + [(700, "<|endoftext|> a,<|startoftext|>.. İSTANBUL Σίσυφος 'tis we'll ½ 3² é")]
    rows = packing.pack(documents(spark, texts), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        copies = 2 if i == 905 else 1
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for r in pieces:
            want = ids[r.start:r.start + r.length].tobytes()
            assert bytes(r.ids) == want and r.ids_crc32 == zlib.crc32(want) and r.doc_tokens == len(ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n.bit_count() == 1 for n in sequences.values())


def test_copies_of_a_text_are_neighbours_on_the_curve(spark):
    rng = random.Random(2)
    kinds = [vocabulary(k, 60) for k in (3, 4)]
    texts = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(80))) for i in range(40)]
    order = [r.doc_id for r in packing.tokenized(documents(spark, texts), PATH).orderBy("curve", "doc_id").collect()]
    changes = sum(a % 2 != b % 2 for a, b in zip(order, order[1:]))
    assert changes < 12  # about 20 in a random order


def test_the_curve_visits_every_cell_in_unit_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.curve_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1).tolist()) == {1}


def test_no_documents_no_pieces(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
