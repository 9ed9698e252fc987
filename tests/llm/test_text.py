"""PII, secrets, language ID and BPE: brute force, exact round trips, held-out accuracy, odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, langid, pii, queries, secrets
from quillon.session import table

ODD = "doc_id long, text string, lang string, source string, n_chars long, spans string, ids string, fp long, block int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, columns whose names the operators use."""
    rows = [(1, None, None, None, None, "x", "y", 1, 2), (2, "", "en", "s", 0, None, None, None, None), (2, "", "en", "s", 0, None, None, None, None), (None, "a b c", None, "s", 5, "x", "y", 3, 4), (5, " \n\t", "xx", None, 3, "", "", 0, 0), (6, "word " * 30000, "en", "s", 1, "", "", 0, 0)]
    return spark.createDataFrame(rows, ODD)


PLAIN_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(ds):
        return sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(ds[::-1])) % 10 == 0

    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN_PII.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_pii_is_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@+-% ()4539 0a.b@c.de") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_pii(text), text
    assert pii.base_spans("card 4111 1111-1111 1111.")[0][0] == "card"


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail jane [at] example (dot) org now", "email", "jane [at] example (dot) org"),
        ("mail jane at example dot org now", "email", "jane at example dot org"),
        ("jаne@example.org", "email", "jаne@example.org"),
        ("call +４４２０７９４６０９５８ soon", "phone", "+４４２０７９４６０９５８"),
        ("pay four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("host １０.0.0.1!", "ip", "１０.0.0.1"),
        ("x a​b@c.de", "email", "a​b@c.de"),
        ("mail jane\tat\texample\tdot\torg now", "email", "jane\tat\texample\tdot\torg"),
        ("mail jan at pivo dot cz now", "email", "jan at pivo dot cz"),
        ("escribe a ana arroba correo punto cl", "email", "ana arroba correo punto cl"),
        ("host one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("ruf plus vier neun 30 eins zwei drei 456 an", "phone", "plus vier neun 30 eins zwei drei 456"),
        ("tel +33 un deux trois 45 six sept", "phone", "+33 un deux trois 45 six sept"),
    ],
)
def test_disguises_map_back(text, kind, span):
    base, every = pii.find_spans(text)
    assert (kind, text.index(span), text.index(span) + len(span)) in every
    assert set(base) <= set(every)
    assert span not in pii.redact(text, every)


def test_plain_words_are_left_alone():
    text = "She was at home, one or two of us. Look at the dot on the map. One two three four five six seven eight, at a dot com fair; point at one dot and one more."
    assert pii.find_spans(text) == ([], []) and pii.redact(text, []) == text


def test_pii_runs_in_linear_time():
    assert pii.find_spans("a" * 300_000) == ([], [])
    assert pii.find_spans("1" * 200_000)[0] == []
    text = "a@b.org x at y dot zz one two three four " * 20_000  # every span is looked up among 20,000
    start = time.perf_counter()
    base, every = pii.find_spans(text)
    assert len(base) == 20_000 and len(every) == 40_000 and time.perf_counter() - start < 10
    start = time.perf_counter()
    base, every = secrets.find_spans("token=abcdefghijkl0123 zK8fQ2mX9pLw3vB7nRt5yHc1dGs6jE4uA0 " * 20_000)
    assert len(base) == 20_000 and len(every) == 40_000 and time.perf_counter() - start < 20


def test_pii_rows(spark, odd):
    got = pii.detect(odd).orderBy("doc_id").collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got)
    assert [r["redacted"] for r in got if r["doc_id"] == 1] == [None]
    assert pii.detect(odd.where("false")).count() == 0


def plain_secrets(text):
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_secrets_are_the_plain_patterns():
    rng = random.Random(4)
    bits = ["password", "API_key", "toKen", "=", ":", " ", '"', "'", "abc123", "AKIA", "XY9Z", "0f3e", "zz/+", "\n", "deadbeef"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_entropy_windows_by_brute_force():
    s = "aaaaabbbbbcccccdddddeeeeefffff0123456789"
    plain = []
    for i in range(len(s) - secrets.WINDOW + 1):
        c = Counter(s[i : i + secrets.WINDOW])
        plain.append(-sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in c.values()))
    assert secrets.window_entropies(s) == pytest.approx(plain)


def test_entropy_finds_and_allows():
    assert secrets.entropy_spans("key q7Zk9LmX2vTp4WrB8nYs1HdJ6 end")
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "aVeryLongCamelCaseIdentifierName", "2024-01-02-03-04-05-06-07", "src/main/resources/application"):
        assert not secrets.entropy_spans(f"see {fine} end"), fine
    assert not secrets.entropy_spans("see q7Zk9Lexample4WrB8nYs1 end")  # too little beside the placeholder
    assert secrets.entropy_spans("see my-example-q7Zk9LmX2vTp4WrB8nYs1HdJ6 end")
    base, every = secrets.find_spans("token=q7Zk9LmX2vTp4WrB8nYs1HdJ6")
    assert base == every and base[0][0] == "assign"


def test_secret_rows(spark, odd):
    assert {r["spans"] for r in secrets.scan(odd).collect()} == {""}
    assert secrets.scan(odd.where("false")).count() == 0


def test_language_accuracy_on_held_out(spark):
    found = queries.op8_language_id(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] >= 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def plain_grams(text):
    marked = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [marked[i - 1 : i + 2] for i in range(1, len(marked) - 1) if marked[i] != " "]


def test_language_by_brute_force(spark):
    """Exact sets of n-grams instead of filters: the same counts but for false positives, and the same decisions."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    learn = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.train(learn, sample_rows=1 << 30)
    seen = {v: Counter() for v in model.languages}
    for r in learn.where("lang is not null and text is not null").collect():
        seen[r["lang"]].update(plain_grams(r["text"]))
    rate = {}
    for v, c in seen.items():
        often = {g: n for g, n in c.items() if n >= langid.LEAST_COUNT}
        total = sum(often.values())
        rate[v] = {g: n / total for g, n in often.items()}
    top = Counter()
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    own = {v: {g for g, x in r.items() if x >= langid.FAIR_SHARE * top[g]} for v, r in rate.items()}
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    counts, total, _ = model.counts(texts)
    pred, score = model.predict(texts)
    same = 0
    for i, t in enumerate(texts):
        grams = plain_grams(t)
        exact = [sum(g in own[v] for g in grams) for v in model.languages]
        assert total[i] == len(grams) and all(abs(a - b) <= 0.05 * len(grams) + 3 for a, b in zip(counts[i], exact, strict=True))
        if grams:
            same += pred[i] == model.languages[max(range(len(exact)), key=lambda k: exact[k])]
            assert abs(score[i] - max(exact) / len(grams)) < 0.1 or len(grams) < 40
        else:
            same += (pred[i], score[i]) == ("und", 0.0)
    assert same >= 0.99 * len(texts)


def test_language_rows(spark, odd):
    train = spark.createDataFrame([(i, t, v) for i in range(40) for t, v in (("the cat and the dog", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string")
    model = langid.train(train)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert rows[1] == rows[2] == rows[5] == ("und", 0.0)
    assert langid.train(train.where("false")).predict(["text"]) == (["und"], [0.0])
    assert model.predict(["the dog", "die katze", "123 !", None])[0] == ["en", "de", "und", "und"]


def test_grams_stay_in_their_text():
    whole = langid.grams(["ab", "cd"])
    assert set(whole[0].tolist()) == set(langid.grams(["ab"])[0].tolist()) | set(langid.grams(["cd"])[0].tolist())


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(queries.tokenizer_path())


def test_bpe_equals_the_library(spark, coder):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    texts += ["", " ", "\n", "it's <|endoftext|>it's 'll", "x" * 3000, "<|startoftext|> a", "é é a ́b", "日本語" * 500, "a b\x1cc\x0bd ΑΣ Σ", "no_space_" * 400, " lead and trail ", "don't 12345 !!!###"]
    for text, (n, ids, plain) in zip(texts, coder.encode(texts), strict=True):
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), text[:40]
        assert plain == coder.tokenizer.decode(want, skip_special_tokens=False)


def spaced_tokenizer(path):
    """A vocabulary whose tokens begin with a space, and no pre-tokenizer: tokens reach across words."""
    from tokenizers import Tokenizer, models

    vocab = {t: i for i, t in enumerate(["a", "b", " ", " b", "ab", " a", "ab ", "aa", " b b", "\n", "é"])}
    merges = [(" ", "b"), ("a", "b"), (" ", "a"), ("ab", " "), ("a", "a"), (" b", " b")]
    Tokenizer(models.BPE(vocab, merges)).save(path)
    return path


@pytest.mark.parametrize("kind", ["bytes", "spaced"])
def test_bpe_of_any_tokenizer_equals_the_library(spark, tmp_path, kind):
    path = spaced_tokenizer(f"{tmp_path}/t.json") if kind == "spaced" else queries.tokenizer_path("byte_bpe_50k.json")
    own = bpe.coder(path)
    assert isinstance(own, bpe.JoinCoder)
    rng = random.Random(6)
    texts = ["a b b a", "", " ", "a" * 4000, " b" * 3000, "ab " * 2000]
    texts += ["".join(rng.choice(["a", "b", " ", " b", "aa", "\n", "é"]) for _ in range(rng.randrange(3000))) for _ in range(60)]
    if kind == "bytes":
        texts += [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r["text"]] + ["日本語😀 " * 700, "x" + " " * 900 + "y", "don't 12345 !!!### <|endoftext|> end"]
    for text, (n, ids, plain) in zip(texts, own.encode(texts), strict=True):
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), text[:40]
        assert plain == own.tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_cuts_follow_content():
    passage = " ".join(str(i * i) for i in range(400))
    inside = lambda t: {s for is_in, s in bpe.ChunkCoder.pieces(t) if is_in}
    assert len(inside("some other start " + passage) & inside("x " + passage)) > 3
    assert "".join(s for _, s in bpe.ChunkCoder.pieces(passage)).replace(" ", "") == passage.replace(" ", "")


def test_bpe_caches_are_bounded(coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 100)
    small = bpe.coder(queries.tokenizer_path())
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(30))
        assert small.encode([text]) == coder.encode([text])
        assert small.word_chars < 1000


def test_bpe_rows(spark, odd):
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_text"], r["decoded"]) for r in bpe.encode_decode(odd, queries.tokenizer_path()).collect()}
    assert rows[1] == rows[2] == rows[5] == (0, "", "") and rows[6][0] == 30000
    ids = bpe.encode_decode(odd, queries.tokenizer_path()).select("doc_id", bpe.ids().alias("ids"))
    assert {r["doc_id"]: len(r["ids"]) for r in ids.collect()}[2] == 0


def test_digest_queries(spark):
    d = "/root/testdata/sf0.001"
    one = queries.op9_pii(spark, d).head()
    text = table(spark, d, "documents").where(F.col("doc_id") == one["doc_id"]).head()["text"]
    assert one["base_sha256"] == hashlib.sha256(pii.written(plain_pii(text)).encode()).hexdigest()
