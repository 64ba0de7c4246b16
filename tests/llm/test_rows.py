"""Operators on single documents: language, HTML, secrets, personal data, scores."""

import itertools
import random
import re
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import langid, lm, pii
from flowsieve.llm.html import extract
from flowsieve.llm.secrets import RULES, Rule, addressed, findings_by_row, scan


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    lengths = [1, 4, 6, 2]
    score = rng.normal(0, 2, (sum(lengths), 3)).astype(np.float32)
    doc = np.repeat(np.arange(4), lengths)
    got = langid.viterbi(score, doc, 1.5)
    at = 0
    for n in lengths:
        s = score[at:at + n]
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert value(got[at:at + n]) == pytest.approx(best, abs=1e-4)
        at += n


def test_language(spark, edge_docs, no_docs):
    en, de, ru = "the house and the garden with them ", "der Hund und die Katze für mich ", "дом и сад для них "
    rows = [(str(i), t * 3, l) for i in range(20) for t, l in ((en, "en"), (de, "de"), (ru, "ru"))]
    model = langid.train(spark.createDataFrame(rows, "key string, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    names, scores = model.predict([en, de * 2 + en, ru + en * 5, "", "12 !?", "The", ru])
    assert names == ["en", "de", "en", "und", "und", "en", "ru"]
    assert scores[0] == scores[6] == 1 and 0.5 < scores[1] < 1 and scores[3] == 0
    found = edge_docs.withColumn("x", langid.language(model, F.col("text"))).select("text", "x.lang", "x.score").collect()
    assert all((r["lang"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in found) and len(found) == 10
    empty = langid.train(no_docs.withColumn("key", F.lit("")))
    assert empty.predict(["some text"])[0] == ["und"]


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice">We use cookies.</div>
{main}
<aside>Side</aside><form>Search <button>go</button></form><section id="comments"><p>First! What a long comment it is, and the
words of it are many, so that it is as long as the article.</p></section><footer>&copy; me"""
TEXT = "This is the first block of the article &amp; it is long enough to be decided on its own, with <b>bo</b>ld words."
CLEAN = "This is the first block of the article & it is long enough to be decided on its own, with bold words."


@pytest.mark.parametrize("main,want", [
    (f"<article><h1>Head\n line</h1><p>{TEXT}<br><p>Short.<p class='ad'>Buy!</p><script>x</script></article>", f"Head line {CLEAN} Short."),
    (f"<main><p>{TEXT}</p><p>So.</p><div class=share>Share</div></main>", f"{CLEAN} So."),
    (f"<div class='post-content'><p>Of it.</p><p>{TEXT}</p></div>", f"Of it. {CLEAN}"),
    (f"<div><p>{TEXT} Also of the rest of it, and on and on.</p><p>Of it.</p><p>{TEXT}</p></div>",
     f"{CLEAN} Also of the rest of it, and on and on. Of it. {CLEAN}"),
    ("", ""),
])
def test_html(main, want):
    assert extract(PAGE.format(main=main)) == want


def test_html_rules_hold_in_articles():
    row = "<p><a href=/a>More of the news of today</a> | <a href=/b>All that was in the week</a> | <a href=/c>This is on the site as well</a></p>"
    text = f"<p>{TEXT}</p>"
    by = "<div>By <a href=/x>Jane Smith of the paper</a></div>"
    assert extract(f"<article><h1>Head</h1>{by}{text}{row}<div><a href=/d>Buy it</a></div><p>So.</p>{text}</article>") == f"Head {CLEAN} So. {CLEAN}"
    tail = f"<article>{text}<h2>Links</h2>{row}{row}<h2>End</h2>{text}<p>&copy; me</p></article>"
    assert extract(tail) == f"{CLEAN} End {CLEAN}"
    card = "<article class=card><h3>Card</h3><p>Short words.</p></article>"
    body = f"<div>{text}<p>Of it.</p>{text}</div>"
    for page in (card + card + body, body + card, card + body + card):
        assert extract(page) == f"{CLEAN} Of it. {CLEAN}"
    assert extract(f"{card}<main><h1>Head</h1>{text}{text}</main>{card}") == f"Head {CLEAN} {CLEAN}"
    assert extract("<article>" * 3000 + text) == CLEAN


def test_html_edges():
    assert extract("") == "" and extract("plain < text") == ""
    assert extract("<article>a < b &lt;i&gt; <!-- x > <p>y</p> -->c d<p>e</article>") == "a < b <i> c d e"
    long = "<article>" + "<p>word of the text " * 20_000
    assert len(extract(long).split()) == 80_000


def brute_spans(text):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
             ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, n) in enumerate(kinds)
             for m in re.finditer(p, text or "", re.A) if len(m[g]) >= n]
    return ",".join(x[2] for x in sorted(found))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["token=pass secret: abcdefgh1", "PassWord = 'x'", 'api_key":"A1b2C3d4E5"', "AKIA0123456789AB", "AKIAAKIA01234567890",
             "0" * 31, "0" * 33 + "g", "é😀", "deadbeef" * 5, "token==abcdefg", " ", "tokentoken:12345678"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(80)] + [None, "", "token=" + "a" * 100_000]
    texts += texts[:5]
    rows = addressed(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ["doc_id"])
    ledger, findings = scan(rows)
    got = {r["doc_id"]: r["spans"] for r in findings_by_row(rows, findings, ["doc_id"]).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert ledger.count() == 3 * len({t or "" for t in texts})


def test_ledger_is_incremental(spark, edge_docs, no_docs):
    first = spark.createDataFrame([(1, "secret: aaaaaaaa"), (2, "secret: aaaaaaaa")], "path int, text string")
    ledger, findings = scan(addressed(first, ["path"]))
    assert ledger.count() == 3 and findings.count() == 1
    again, none = scan(addressed(first, ["path"]), ledger=ledger)
    assert again.count() == 0 and none.count() == 0
    rules = [*RULES, Rule("pin", 1, r"pin\d+")]
    more = addressed(first.union(spark.createDataFrame([(3, "pin77")], "path int, text string")), ["path"])
    new, hits = scan(more, rules, ledger)
    assert new.count() == 1 + 4 and [r["rule"] for r in hits.collect()] == ["pin"]
    rows = addressed(edge_docs, ["doc_id"])
    assert findings_by_row(rows, scan(rows)[1], ["doc_id"]).count() == 10
    assert scan(addressed(no_docs, ["doc_id"]))[0].count() == 0


def test_surrogates(spark, edge_docs, no_docs):
    texts = [
        "Mail Jane.Doe@site.org or +1 (555) 123-4567, card 4111 1111 1111 1111.", "mail jane.doe@site.org; call +1 (555) 123-4567!",
        "Mrs. Jane Smith met Mr. John Smith. Mrs. Smith left. Herr MÜLLER came", "IP 10.20.30.40, ssn 123-45-6789, DE44 5001 0517 5407 3249 31",
        "No data here, 3.14 and version 4.0.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.pseudonymized(docs, "k", ["doc_id"]).collect()}
    for i in range(4):
        old, new = pii.mentions(texts[i]), pii.mentions(got[i][0])
        assert [m.kind for m in old] == [m.kind for m in new]
        assert all(re.sub(r"\w", "", a.written) == re.sub(r"\w", "", b.written) for a, b in zip(old, new) if "name" not in a.kind)
        assert not {m.entity for m in old} & {m.entity for m in new}
    a, b = pii.mentions(got[0][0]), pii.mentions(got[1][0])
    assert a[0].entity == b[0].entity and a[1].written == b[1].written and pii._luhn(a[2].entity) == 0
    jane, smith, john, smith2, smith3, mueller = pii.mentions(got[2][0])
    assert smith.written == smith2.written == smith3.written and mueller.written.isupper()
    assert jane.entity.split("-")[0].capitalize() in pii.GIVEN["f"] and john.entity.split("-")[0].capitalize() in pii.GIVEN["m"]
    assert got[4] == (texts[4], 0) and got[5] == (None, 0)
    assert pii.pseudonymized(edge_docs, "k", ["doc_id", "row"]).count() == 10 and pii.pseudonymized(no_docs, "k", ["doc_id"]).count() == 0


def test_names_without_title_follow(spark):
    texts = ["Jane came. Mrs. Jane Smith called. Later Jane wrote to Smith, SMITH's son and Smithson; smith and jane.smith@a.org stay.",
             "Jane and Smith of another text stay.", "Mr. A Poe saw A Plan of Poe's and Poe-like Mr. Poe's."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymized(docs, "k", ["doc_id"]).collect()}
    jane, smith = (m.written for m in pii.mentions(got[0])[:2])
    assert jane != "Jane" and smith != "Smith"
    mail = pii.mentions(got[0])[-1].written
    assert got[0] == (f"{jane} came. Mrs. {jane} {smith} called. Later {jane} wrote to {smith}, {smith.upper()}'s son and Smithson; "
                      f"smith and {mail} stay.")
    assert got[1] == texts[1]
    a, poe = (m.written for m in pii.mentions(got[2])[:2])
    assert got[2] == f"Mr. {a} {poe} saw A Plan of {poe}'s and {poe}-like Mr. {poe}'s."


def test_surrogates_of_all_scripts(spark):
    names = ["王小明", "김철수", "さくら", "カタカナ", "अमित", "สมชาย", "გიორგი", "محمد", "كريم", "דוד", "Иван", "Ωνάσης", "Nguyễn", "Արամ", "ক"]
    texts = [f"Mr. {n} came" for n in names] + [
        "call ٠٥٥ ١٢٣ ٤٥٦٧ now", "call 055 123 4567 now", "MT84 MALT ABCD is all", "x\u0301Mr. ²Q", "Frau ǅx", "a@b.cd", "+1234567", "(12) 345 67"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    quick = {r["doc_id"]: r["q"] for r in docs.select("doc_id", F.rlike("text", F.lit(pii.QUICK)).alias("q")).collect()}
    assert all(quick[i] for i, t in enumerate(texts) if pii.mentions(t)) and sum(bool(pii.mentions(t)) for t in texts) >= len(texts) - 1
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymized(docs, "k", ["doc_id"]).collect()}
    for i, name in enumerate(names):
        assert [m.written for m in pii.mentions(texts[i])] == [name]
        new = got[i][len("Mr. "):-len(" came")]
        if name != "Nguyễn":
            assert len(new) == len(name) and {pii._script(c) for c in new if c.isalpha()} == {pii._script(c) for c in name if c.isalpha()}
            assert not any(a == b for a, b in zip(new.lower(), name.lower()) if a.isalpha())
        assert new[0].isupper() == name[0].isupper() and name not in got[i]
    arabic, ascii_ = (re.sub(r"\D", "", got[len(names) + i]) for i in (0, 1))
    assert ascii_ != "0551234567" and int(arabic) == int(ascii_) and min(arabic) >= "٠" and ascii_.isascii()
    assert len({pii._like("ب", pii.Draw(b"k", "x", str(i), 0)) for i in range(400)}) > 25


def test_surrogates_do_not_collide(spark):
    known = spark.range(150).select(F.lit("name_f").alias("kind"), F.concat(F.lit("n"), "id").alias("entity")).union(
        spark.createDataFrame([("name_m", g.lower()) for g in pii.GIVEN["m"]], "kind string, entity string"))
    rows = pii.draw_surrogates(known, "k").collect()
    drawn = [r["surrogate"] for r in rows]
    assert len(rows) == len(set(drawn)) == 170 and not set(drawn) & {r["entity"] for r in rows}
    assert rows and sorted(map(tuple, pii.draw_surrogates(known.repartition(5), "k").collect())) == sorted(map(tuple, rows))


def test_gradient_and_scores():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, lm.VOCABULARY, n) for n in (7, 0, 1, 30)]
    w = lm.initial_weights(1, np.arange(lm.VOCABULARY))
    total = lm.log_probabilities(w, docs)
    for d, got in zip(docs, total):
        padded = [lm.PAD] * lm.SIDE + list(d) + [lm.PAD] * lm.SIDE
        want = 0.0
        for i, word in enumerate(d):
            sides = padded[i:i + lm.SIDE] + padded[i + lm.SIDE + 1:i + 2 * lm.SIDE + 1]
            h = np.tanh(w["embed"][sides].ravel() @ w["inner"] + w["inner_bias"])
            c = word // lm.CLASSES
            for z, k in ((h @ w["classes"] + w["class_bias"], c), (h @ w["words"][c] + w["word_bias"][c], word % lm.CLASSES)):
                want += z[k] - np.log(np.exp(z).sum())
        assert got == pytest.approx(want, abs=1e-3)
    flat, at = lm._padded(docs)
    sides, target = lm._sides(flat, at), flat[at]
    mean = lambda x: float(lm._forward(x, sides, target)[-1].astype(np.float64).mean())
    moved = {k: v.copy() for k, v in w.items()}
    lm.step(moved, sides, target, 1e-2)
    gradient = {k: (moved[k].astype(np.float64) - w[k]) / 1e-2 for k in w}
    for k, where in (("inner", (3, 4)), ("class_bias", (5,)), ("embed", (int(sides[2, 1]), 2))):
        up, down = ({n: v.astype(np.float64).copy() for n, v in w.items()} for _ in range(2))
        up[k][where] += 1e-4
        down[k][where] -= 1e-4
        assert gradient[k][where] == pytest.approx((mean(up) - mean(down)) / 2e-4, abs=2e-3)
    before = mean(w)
    for _ in range(20):
        lm.step(w, sides, target, 0.5)
    assert mean(w) > before


def test_scored_edges(edge_docs, no_docs):
    rows = lm.scored(edge_docs, ["doc_id", "size"], rounds=1).collect()
    assert len(rows) == 10 and sum(r["n_tokens"] == 0 for r in rows) == 3
    assert all((r["mean_logprob"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert lm.scored(no_docs, ["doc_id"], rounds=1).count() == 0


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS_PER_ID", 2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(w for k, w in enumerate(words) for _ in range(1 + 9 // (1 + k)) if (k + d) % 4) for d in range(6)] + ["w5 once", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    count = Counter(w for t in texts for w in t.split())
    alone, totals = lm.tokenized(docs, ["doc_id"])
    assert len(totals) == lm.classes_for(len(count)) ** 2 > lm.VOCABULARY and totals.sum() == sum(count.values())
    id_of, rows = {}, {r["doc_id"]: r for r in alone.collect()}
    for d, text in enumerate(texts):
        ids = np.frombuffer(rows[d]["tokens"], np.uint32)
        assert len(ids) == len(text.split())
        id_of |= dict(zip(text.split(), ids))
    for d, text in enumerate(texts):
        assert rows[d]["within"] == pytest.approx(sum(np.log(count[w] / totals[id_of[w]]) for w in text.split()))
    assert len(set(id_of.values())) < len(id_of) and any(r["within"] < 0 for r in rows.values())
    assert lm.classes_for(68_844) < lm.classes_for(280_729)
    got = {r["doc_id"]: r for r in lm.scored(docs, ["doc_id"], rounds=1).collect()}
    weights = lm.train(alone, totals, 1)
    for r in alone.collect():
        want = lm.log_probabilities(weights, lm._ids([r["tokens"]]))[0] + r["within"]
        assert got[r["doc_id"]]["logprob"] == pytest.approx(want, abs=1e-2)


def test_runs_are_ordered_by_length():
    rng = np.random.default_rng(3)
    part = np.concatenate([np.arange(4), rng.integers(0, 4, 300)])
    key = (40 * rng.random(304) ** 3).astype(np.int64)
    order, runs = lm._runs(part, key)
    assert sorted(order) == list(range(304)) and len(runs) == 4
    for p in range(4):
        mine = key[order][part[order] == p]
        want = Counter(key[part == p].tolist())
        assert [(n, k) for n, at, keys in runs[p] for k in keys] == sorted((n, k) for k, n in want.items())
        for n, at, keys in runs[p]:
            assert mine[at:at + n * len(keys)].tolist() == np.repeat(keys, n).tolist()


def test_step_against_one_position_at_a_time():
    rng = np.random.default_rng(4)
    classes = 40
    w = lm.initial_weights(4, np.arange(classes ** 2))
    target = np.concatenate([np.full(60, 7), np.repeat(np.arange(1, 13) * classes, np.arange(1, 13)), rng.integers(0, classes ** 2, 100)])
    sides = (classes ** 2 * rng.random((len(target), 2 * lm.SIDE)) ** 4).astype(np.int64)
    want = {k: v.astype(np.float64) for k, v in w.items()}
    for side, t in zip(sides, target):
        c, word = divmod(t, classes)
        x = w["embed"][side].ravel().astype(np.float64)
        h = np.tanh(x @ w["inner"] + w["inner_bias"])
        rate, dh = 0.7 / len(target), 0
        for k, bias, place, wanted in (("classes", "class_bias", ..., c), ("words", "word_bias", c, word)):
            z = h @ w[k][place] + w[bias][place]
            error = np.exp(z) / np.exp(z).sum()
            error[wanted] -= 1
            dh = dh + w[k][place] @ error
            want[k][place] -= rate * np.outer(h, error)
            want[bias][place] -= rate * error
        dz = dh * (1 - h * h)
        want["inner"] -= rate * np.outer(x, dz)
        want["inner_bias"] -= rate * dz
        np.subtract.at(want["embed"], side, rate * (w["inner"] @ dz).reshape(-1, lm.EMBEDDING))
    lm.step(w, sides, target, 0.7)
    assert all(w[k] == pytest.approx(want[k], abs=2e-6) for k in w)


def test_large_values_have_probabilities():
    w = lm.initial_weights(5)
    w["class_bias"][3], w["class_bias"][4], w["word_bias"][3, 2] = 500, -500, 300
    sides, target = np.full((2, 2 * lm.SIDE), lm.PAD), np.array([3 * lm.CLASSES + 2, 4 * lm.CLASSES])
    found = lm._forward(w, sides, target)[-1]
    assert found[0] == pytest.approx(0, abs=1e-4) and -1020 < found[1] < -990
    lm.step(w, sides, target, 0.1)
    assert all(np.isfinite(v).all() for v in w.values())


def test_cost_of_a_step_and_of_scores():
    """Calls of a step do not grow with the classes in it, and scoring holds no layer of all positions."""
    def calls(classes: int) -> int:
        w = lm.initial_weights(6, np.ones(classes ** 2))
        target = np.repeat(np.arange(classes), 4) * classes
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            lm.step(w, np.tile(target[:, None], 2 * lm.SIDE), target, 0.1)
        finally:
            sys.setprofile(None)
        return len(seen)

    assert calls(121) < calls(40) + 40
    classes = 121
    w = lm.initial_weights(6, np.ones(classes ** 2))
    doc = np.random.default_rng(6).integers(0, classes ** 2, lm.SLICE)
    tracemalloc.start()
    lm.log_probabilities(w, [doc])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * lm.SLICE * classes * 4


def test_every_position_is_trained(spark):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, lm.VOCABULARY, n) for n in (0, 40_000, 3, 70_000, 1, 30_000)]
    ways = [[docs], [[d] for d in docs], [docs[:2], [], docs[2:]]]
    parts = [[*lm._slices(iter(way), lm.PAD)] for way in ways]
    assert all([len(t) for _, t in p] == [lm.SLICE, lm.SLICE, 140_004 - 2 * lm.SLICE] for p in parts)
    assert (np.concatenate([t for _, t in parts[0]]) == np.concatenate(docs)).all()
    learned = []
    for way in ways:
        w = lm.initial_weights(1)
        assert lm.learn(w, iter(way)) == 140_004
        learned.append(lm.pack(w))
    assert (learned[0] == learned[1]).all() and (learned[0] == learned[2]).all()
    # One partition: the weights are those of its own steps.
    rows = spark.createDataFrame([(d.astype(np.uint32).tobytes(),) for d in docs], "tokens binary").coalesce(1)
    assert lm.pack(lm.train(rows, rounds=1, seed=1)) == pytest.approx(learned[0], abs=1e-5)


LEFT_ALONE = ["On 2024-01-15 we met", "due 12-11-2023 or 3.12.2021", "the years 1999 2000 2001", "from 1999-2004", "ISBN 978-3-16-148410-0",
              "ISBN 0-306-40615-2", "at 12:30:45 sharp", "a::b and std::vector", "see 10-20 and 3-4", "Dear reader"]
REPLACED = [("MR. JOHN SMITH called", ["JOHN", "SMITH"]), ("(555)123-4567", ["(555)123-4567"]), ("dial 555-1234 now", ["555-1234"]),
            ("host 2001:db8::1 up", ["2001:db8::1"]), ("fe80::a:b", ["fe80::a:b"]), ("+49 30 123456", ["+49 30 123456"]),
            ("call 030-1234-5678", ["030-1234-5678"]), ("DR. EVE", ["EVE"]), ("192.168.2.77", ["192.168.2.77"])]


def test_probed_lines(spark):
    """Lines the patterns were not written for: what stays, and what goes."""
    for text in LEFT_ALONE:
        assert pii.mentions(text) == [], text
    for text, parts in REPLACED:
        written = [m.written for m in pii.mentions(text)]
        assert len(written) == len(parts) and all(w.startswith(p) for w, p in zip(written, parts)), (text, written)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in REPLACED] + LEFT_ALONE)], "doc_id bigint, text string")
    quick = [r["q"] for r in rows.orderBy("doc_id").select(F.rlike("text", F.lit(pii.QUICK)).alias("q")).collect()]
    assert all(quick[:len(REPLACED)])
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymized(rows, "k", ["doc_id"]).collect()}
    for i, (text, parts) in enumerate(REPLACED):
        assert got[i] != text and not any(p in got[i] for p in parts)
    assert [got[len(REPLACED) + i] for i in range(len(LEFT_ALONE))] == LEFT_ALONE
