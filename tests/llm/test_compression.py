import base64
import collections
import random
import re

import zstandard

from tests.llm.data import documents, odd, sentence, vocabulary
from waybridge.llm import compression


def counted(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w)]


def test_counts_and_base_rule(spark):
    rng, words = random.Random(7), vocabulary(7, 30) + ["#", "a|b", "é è", "\x1c", "\x85x", "漢"]
    texts = [(i, rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    texts += [(200, "one two three four five six\n" * 3), (201, "x y z w v x y z w v x y z w v a b c d e f g")] + odd(rng, words)
    by_id = dict(texts)
    got = compression.judge(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r)[1:7] == counted(by_id[r.doc_id] or ""), r.doc_id


def test_bands_reject_repetition_and_noise_and_keep_prose(spark):
    rng, words = random.Random(8), vocabulary(8, 2_000)
    prose = [" ".join(sentence(rng, words, 12) for _ in range(n)) for n in (3, 12, 60, 300)]
    # letters shifted by one each time: no window of words repeats, yet it is all one pattern
    flat = " ".join("ab" * 30 + str(i % 10) + "ab" * (i % 7) for i in range(400))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(1_500))
    got = [r.kept for r in compression.judge(documents(spark, prose + [flat, noise], False)).orderBy("doc_id").collect()]
    assert got == [True] * 4 + [False] * 2
    assert compression.judge(documents(spark, [])).count() == 0


def passes(data):
    return compression.bands(data, zstandard.ZstdCompressor(level=compression.LEVEL))[2]


def test_noise_of_every_alphabet_is_rejected():
    rng = random.Random(10)
    lower = "abcdefghijklmnopqrstuvwxyz"
    base = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    spelled = lambda letters, n: " ".join(
        "".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)).encode()[:n]
    for n in (4_096, 5_000, 6_000, 8_191, 20_000, 100_000):
        noise = {"base64": base(n), "hex": rng.randbytes(n).hex().encode()[:n], "words": spelled(lower, n),
                 "mixed": spelled(lower + lower.upper() + "0123456789", n)}
        assert [k for k, data in noise.items() if passes(data)] == [], n
    assert not any(passes(base(n)) or passes(spelled(lower + lower.upper() + "0123456789", n)) for n in (1_000, 2_000))


def test_texts_with_a_part_of_noise_are_rejected():
    rng, words = random.Random(11), vocabulary(11, 400)
    prose = " ".join(sentence(rng, words, 12) for _ in range(3_000)).encode()
    base = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    for share in (0.3, 0.5, 0.6, 0.8):
        for n in (20_000, 100_000):
            k = int(share * n)
            assert not passes(base(k) + prose[:n - k]) and not passes(prose[:n - k] + base(k)), (share, n)
    for share in (0.5, 0.6, 0.8):
        lines = [base(76) if rng.random() < share else prose[i:i + 76] for i in range(0, 100_000, 76)]
        assert not passes(b"\n".join(lines)), share
    # a text of one chunk and a bit, the bit being noise
    assert passes(prose[:6_000]) and not passes(prose[:4_096] + base(2_000))


def test_prose_of_two_scripts_passes():
    rng = random.Random(12)
    chinese = [chr(0x4E00 + k) for k in rng.sample(range(20_000), 400)]
    pairs = ["".join(rng.choices(chinese, k=2)) for _ in range(300)]
    text = "，".join("".join(rng.choice(pairs) for _ in range(6)) for _ in range(4_000)).encode()
    words = vocabulary(12, 1_000)
    latin = " ".join(sentence(rng, words, 12) for _ in range(300)).encode()
    for n in (250, 500, 1_000, 2_000, 4_096, 5_000, 8_000):
        assert passes(text[:n]) and passes(latin[:n]), n
