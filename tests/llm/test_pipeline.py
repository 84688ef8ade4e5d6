import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.data import documents, save, sentence, vocabulary
from tests.llm.test_line_dedup import kept_lines
from tests.llm.test_signature_join import by_hand as joined_by_hand
from tests.llm.test_winnowing import by_hand as hit_by_hand


def test_every_stage_against_brute_force(spark, tmp_path):
    rng, words = random.Random(21), vocabulary(21, 700)
    line = sentence(rng, words, 14)
    items = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(4)]
    texts, labels = [], []
    for i in range(300):
        good = rng.random() < 0.75
        t = [sentence(rng, words, rng.randint(8, 20)) for _ in range(rng.randint(1, 6))]
        if good and i % 10 == 3:
            t.append(line)
        if good and i % 11 == 5:
            t.append(items[i % 4])
        if good and i % 9 == 2 and texts:
            t = [rng.choice([x for _, x in texts if "|" not in x]) + " " + rng.choice(words)]
        text = "\n".join(t) if good else " | ".join(" ".join(t).split())
        texts.append((i, text))
        if i % 3:
            labels.append((i, int(good), 0))
    texts += [(400, None), (401, ""), (402, " \n ")]
    save(documents(spark, texts), tmp_path, "documents")
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), tmp_path, "benchmark")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    clean = lambda pairs: sorted((i, t or "") for i, t in pairs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "jaccard_join", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stages[name](spark, docs, sf).write.parquet(f"{sf}/{name}")
        return spark.read.parquet(f"{sf}/{name}")

    one = step("quality", docs)
    assert one.columns == corpus_pipeline.COLUMNS
    left = {i for i, _ in rows(one)}
    good = {i for i, t in texts if i < 400 and "|" not in t}
    assert len(good - left) <= 3 and len(left - good - {400, 401, 402}) <= 5
    two = step("line_dedup", one)
    want = kept_lines([(i, t) for i, t in texts if i in left])
    assert clean(rows(two)) == sorted((i, "\n".join(x)) for i, (x, _) in want.items())
    assert two.where("coalesce(n_chars, 0) <> coalesce(length(text), 0)").count() == 0
    three = step("jaccard_join", two)
    groups = joined_by_hand(rows(two), 5, 80)
    assert clean(rows(three)) == clean((i, t) for (i, t), g in zip(rows(two), groups) if g[0] == g[2])
    assert three.count() < two.count()
    four = step("decontamination", three)
    hits = hit_by_hand(rows(three), list(enumerate(items)))
    assert clean(rows(four)) == clean((i, t) for (i, t), h in zip(rows(three), hits) if not h[-1])
    assert four.count() < three.count() and four.columns == corpus_pipeline.COLUMNS
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    want = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in rows(four)}
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == want
