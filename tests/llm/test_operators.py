"""Small cases of the text operators against plain Python."""

import hashlib
import re
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.llm import decontaminate, fingerprints, html_extract, license_scan, mixing, ngram_join, pii, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    BASE, BASE, BASE.replace("w30", "other"), None, "", "   \n\t", "one two", "one two", "One  TWO", " ".join(f"z{i}" for i in range(300)),
    "call +1 (988) 555-2485 or a.b@mail6.example.com, 53.183.220.240 and 4111 1111 1111 1111", "1.2.3.999 +12 x@y", "Released under the MIT License.",
    "the cat sat on the mat and the dog ran in the park", "ñandú Überraschung 🎉 <|endoftext|> it's", "x" * 30_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, sep="[^\x20\x09-\x0d]+"):
    w = re.findall(sep, (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, docs, none):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    for few in (16, 0):  # 0: every token is hot, so that groups decide
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark, docs, few=few).collect()}
        assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert ngram_join.ngram_join(spark, none).isEmpty()


def test_license_scan(docs, none):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[12].labels, got[12].n_base, got[12].first_word, got[12].score) == ("mit", 1, 3, 1.0)
    assert got[3].n_words == 0 and got[3].first_word is None and got[13].labels == ""
    assert license_scan.license_scan(none).isEmpty()


def test_license_notice_inside_a_long_text(spark):
    notice = dict(reversed(license_scan.TEMPLATES))["mit"]
    text = " ".join(["word"] * 500) + " " + license_scan.TEMPLATES[8][1] + " " + " ".join(["word"] * 500)
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert notice and row.labels == "mit" and row.n_base == 0 and row.score == 1.0


def test_license_words_that_tell_labels_apart(spark):
    want = {
        "Licensed under CC BY-NC 4.0": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY 4.0": "", "Licensed under CC BY-NC-SA 4.0": "",
        "Er kam mit ihr. Released under the Apache License": "apache", "This is released under the MIT License": "mit", "Licensed under the Apache License, Version 2.0": "apache",
        "cc by nc " + "word " * 200 + "licensed under cc by sa 4 0": "cc-by-sa", "word " * 75 + "licensed under cc by nc 4 0": "cc-by-nc", "under mit terms the license was released": "",
    }
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.license_scan(rows).collect()} == dict(enumerate(want.values()))


def test_license_blocks_by_brute_force(spark):
    rng = np.random.default_rng(6)
    templates = [(label, t.split()) for label, t in license_scan.TEMPLATES]
    texts = [None, "", "mit " * 3000]
    for k in range(120):
        w = [str(x) for x in rng.choice(["the", "report", "license", "mit", "new", "under", "of"], rng.integers(0, 200))]
        label, t = templates[k % len(templates)]
        t = [x for x in t if rng.random() > 0.15] if k % 3 else list(t)
        at = int(rng.integers(0, len(w) + 1))
        texts.append(" ".join(w[:at] + t + w[at:]))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    size = license_scan.BLOCK
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        base = {(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()}
        labels, best = {label for _, label in base}, float(bool(base))
        for start in range(0, len(w), size // 2):
            block = w[start : start + size]
            for label, t in templates:
                share = len(set(block) & set(t)) / len(set(t))
                key = license_scan.KEYS.get(label, "-").split()
                if f" {' '.join(key)} " in f" {' '.join(t)} ":
                    ends = [p + len(key) for p in range(len(block)) if block[p : p + len(key)] == key]
                    if not any(w[start + e : start + e + 1] not in (["nd"], ["sa"]) for e in ends):
                        continue
                if share * 100 >= 80 and len(set(block) & set(t)) * 100 >= 80 * len(set(t)):
                    labels.add(label)
                    best = max(best, share)
        assert (got[i].n_base, got[i].labels) == (len(base), ",".join(sorted(labels))), text
        assert got[i].score == pytest.approx(best) and got[i].first_word == (min(p for p, _ in base) if base else None)


def test_pii_patterns(spark, docs, none):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in pii.sanitise(spark, docs).collect():
        found = []
        for kind, p in plain.items():
            for m in re.finditer(p, TEXTS[r.doc_id] or ""):
                d = re.sub("[^0-9]", "", m[0])
                double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                ok = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0, "phone": 9 <= len(d) <= 15}
                if ok[kind]:
                    found.append((kind, m.start(), m.end()))
        assert [(s.kind, s.start, s.end) for s in r.spans] == found
        if r.doc_id == 10:
            assert r.clean == "call [PHONE] or [EMAIL], [IP] and [CARD]"
    assert pii.sanitise(spark, none).isEmpty()


def test_pii_disclosing_term(spark):
    rows = [(i, f"w{i} x helpline +1 555 555 {1000 + i} thanks w{i}") for i in range(30)] + [(100 + i, "some other thanks words") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = pii.sanitise(spark, df).where("doc_id = 3").first()
    assert "term" in {s.kind for s in r.spans} and r.clean == "w3 x [PHONE] [PHONE] thanks w3"  # it discloses the kind only


def test_pii_term_that_discloses_one_entity(spark):
    rows = [(i, f"see Özgür Klarfeld o.k@mail.example.com today {x}") for i, x in enumerate(["first words", "second one", "third thing"])]
    rows += [(10, "Later Özgür and KLARFELD went on"), (11, "the unheard beside q.r@mail.example.com today")] + [(100 + i, f"see some other words for today number n{i} mail example com") for i in range(400)]
    got = {r.doc_id: r for r in pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].clean == "see   [EMAIL] today first words" and got[10].clean == "Later  and  went on"
    assert [s.kind for s in got[11].spans] == ["email"] and got[100].spans == []
    copies = spark.createDataFrame([(i, "see Özgür o.k@mail.example.com today") for i in range(3)] + rows[5:], "doc_id long, text string")
    assert pii.sanitise(spark, copies).where("exists(spans, s -> s.kind = 'term')").isEmpty()


def test_url_filter(spark):
    urls = ["https://a.example.com/en/1", "http://EXAMPLE.com/en/71?x", "https://b.net/de/", "ftp://x.example.net/de/8#a", None, "nothing", "http://com.evil/en/", "http://q.org/es/?", "http://a.org/fr/1"]
    got = {r.page_id: r for r in url_filter.url_filter(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(9)] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, None, None, "org/es/", None]
    assert (got[1].host, got[1].path, got[1].verdict, got[4].host, got[4].path) == ("example.com", "/en/71", "allow", "", "")
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_given_url_rules_are_those_of_the_contract(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = {rule: verdict for verdict, rule in (x.split(" ") for x in contract.split(", "))}
    urls = [f"http://{'' if i % 2 else 'a-b.'}{rule}{i}" for i, rule in enumerate(sorted(want) * 4)] + ["x://EXAMPLE.net/de/7", "x://example.net/de/80/?q", "x://net/de", "x://a.com/en/7"]
    got = {r.page_id: r for r in url_filter.url_filter(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(20)] == sorted(want) * 4 and [got[i].rule for i in range(20, 24)] == ["net/de/", "example.net/de/8", None, "com/en/"]
    assert all(r.verdict == want[r.rule] for r in got.values() if r.rule)


def test_url_rules_that_are_mined(spark):
    rules = (("block", "bad.org", "x/"), ("allow", "good.org", "y/"))
    urls = [f"http://casino{'-' * (i % 2)}win.bad.org/x/{i}" for i in range(40)] + [f"http://s{i}.good.org/y/news/{i}" for i in range(40)]
    urls += [f"http://site{i}.net/z/{i}" for i in range(100)] + ["http://casino-win.elsewhere.net/q", "http://other.elsewhere.net/q", "x", None, "http://" + "a" * 9000 + ".net/z/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    got = {r.page_id: r for r in url_filter.url_filter(spark, df, rules=rules).collect()}
    assert len(got) == len(urls) and all(got[i].verdict == "block" and got[i].rule == "bad.org/x/" for i in range(40))
    assert (got[180].verdict, got[180].rule, got[180].mined) == ("block", None, "h:win")  # of equal rules the larger tokens
    assert all(got[i].verdict == "allow" for i in (100, 181, 182, 183, 184))
    # Brute force: every pair, single or triple of tokens, its confidence, lift and count.
    _, sets = url_filter.labelled(spark, df, "page_id", "url", rules)
    rows = [(frozenset(r.tokens), r.given) for r in sets.collect()]
    counts, share = {}, {v: sum(g == v for _, g in rows) / len(rows) for v in ("allow", "block", "none")}
    for tokens, g in rows:
        for k in range(1, len(tokens) + 1):
            for x in combinations(sorted(tokens), k):
                counts.setdefault(x, {}).setdefault(g, 0)
                counts[x][g] += 1
    good = {(x, v): c[v] / sum(c.values()) for x, c in counts.items() for v in c if c[v] >= 5 and c[v] / sum(c.values()) >= 0.8 and c[v] / sum(c.values()) / share[v] >= 1.2}
    want = {(x, v) for (x, v), p in good.items() if not any(good.get((y, v), 0) >= p for y in combinations(x, len(x) - 1))}
    assert {(tuple(sorted(x)), r.label) for r in url_filter.mine(spark, sets).collect() for x in product(*r.alike)} == want
    told = {(r.given, r.label): r.n for r in url_filter.held_out(spark, df, rules=rules).collect()}
    assert sum(n for (g, v), n in told.items() if g == v) / sum(told.values()) > 0.9
    assert url_filter.url_filter(spark, df.limit(0)).isEmpty()


def test_token_counts(docs, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(["'", "s", "re", "ll", " ", "  ", "\n", "1", "é", "×", "¼", "a", "!!", "日"], rng.integers(0, 9))) for _ in range(2000)]
    texts = [t or "" for t in TEXTS] + odd
    assert token_counts.ByteMerges(path).counts(pa.array(texts)).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: (r.n_bytes, r.over_limit) for r in token_counts.token_counts(docs, path).collect()}
    assert got[3] == (0, False) and got[15] == (30_000, True)
    assert token_counts.token_counts(none, path).isEmpty()


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"z{i}" for i in range(100, 130))), (2, "absent words that no text has at all"), (3, None), (4, BASE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(spark, docs, items).collect()}
    sep = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = {(i, r.item_id) for i, t in enumerate(TEXTS) for r in items.collect() if (s := shingles(r.text, sep)) and len(s & shingles(t, sep)) * 100 >= len(s) * 80}
    assert got == want and (9, 1) in got and (0, 4) in got
    assert decontaminate.contained(spark, none, items).isEmpty()


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, docs).collect()}
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0 and got[13].fingerprint != ""
    assert fingerprints.fingerprints(spark, none).isEmpty()


def signatures(text):
    """A text's signature set by walking over its words."""
    w = [x for x in re.split(fingerprints.SEPARATORS, (text or "").lower()) if x]
    found = set()
    for i, x in enumerate(w):
        content = [y for y in w[i + 1 :] if y not in fingerprints.ANCHORS][:2]
        if x in fingerprints.ANCHORS and len(content) == 2:
            found.add((x, *content))
    return found


def jaccard(a, b, same):
    return len(a & b) / len(a | b) if a or b else float(same)


def test_fingerprints_by_brute_force(spark, docs):
    sets = [signatures(t) for t in TEXTS]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, docs).collect()}
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert len(got[i].fingerprint) == 16 * len(sets[i]) and len(got[i].edited_fingerprint) == 16 * len(signatures(edited))
        assert got[i].near_edited == pytest.approx(jaccard(sets[i], signatures(edited), t == edited))
        assert got[i].near_next == pytest.approx(jaccard(sets[i], sets[(i + 1) % len(sets)], t == after))


def test_fingerprint_search_by_brute_force(spark, none):
    rng = np.random.default_rng(4)
    words = ["the", "of", "and", *[f"c{i}" for i in range(40)]]
    base = [list(rng.choice(words, n)) for n in (60, 90, 130, 200)]
    texts = [None, "", "the"]
    for k in range(60):
        w = list(base[k % 4])
        for at in rng.integers(0, len(w), k // 8):
            w[at] = str(rng.choice(words))
        texts.append(" ".join(w))
    texts += [texts[5], texts[5]]
    df = fingerprints.prints_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = {i: signatures(t) for i, t in enumerate(texts)}
    for least in (0.5, 0.8):
        want = {(q, i) for q in sets if q % 5 == 0 and sets[q] for i in sets if jaccard(sets[q], sets[i], False) >= least}
        got = {(r.query_id, r.doc_id): r.likeness for r in fingerprints.search(spark, df, df.where("doc_id % 5 = 0"), least).collect()}
        assert set(got) == want and all(v == pytest.approx(jaccard(sets[q], sets[i], False)) for (q, i), v in got.items())
    assert fingerprints.search(spark, fingerprints.prints_of(none), df).isEmpty()


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    texts, y = [], []
    for i in range(900):
        w = list(rng.choice(words, 30))
        if i % 6 == 0:
            w[rng.integers(30)] = str(rng.choice(["vile", "nasty"]))
        texts.append(" ".join(w))
        y.append(float(i % 6 == 0))
    m = toxicity.fit(pa.array(texts[:600]), np.array(y[:600], np.float32))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[600:], None, ""])], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(spark, df, m).collect()}
    right = [got[i].predicted == y[600 + i] for i in range(300)]
    assert np.mean(right) > 0.97 and got[300].score == got[301].score
    assert all(r.score == 0 for r in toxicity.toxicity(spark, df, None).collect())


def test_toxicity_forward_pass_by_loops():
    rng = np.random.default_rng(2)
    texts = ["", "one", "one two", *[" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(1, 40))) for _ in range(40)]]
    m = toxicity.fit(pa.array(texts), np.array([i % 3 == 0 for i in range(len(texts))], np.float32))
    words, at = toxicity._words(pa.array(texts))
    ids = (words % np.uint64(toxicity.BUCKETS)).astype(int)
    for i, got in enumerate(m.logits(words, at)):
        mine, pooled = ids[:, at[i] : at[i + 1]], []
        for width, table in zip(toxicity.WIDTHS, m.tables, strict=True):
            places = range(mine.shape[1] - width + 1)
            for f in range(toxicity.FILTERS):
                pooled.append(max((sum(float(table[row[p + j], j * toxicity.FILTERS + f]) for j in range(width) for row in mine) for p in places), default=0.0))
        assert got == pytest.approx(m.constant + sum(max(p + b, 0) * o for p, b, o in zip(pooled, m.bias, m.out, strict=True)), abs=1e-3)


@pytest.mark.parametrize("limit", [120, 4000])
def test_toxicity_thresholds_count_all_labelled_rows(spark, limit):
    rows = [(i, ("el perro en la casa " if i % 6 == 0 else "the dog in the house ") * 3 + ("vile" if i % 30 == 0 else f"word{i % 50}"), int(i % 30 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    usable = lambda i: i % 10 != 9
    model, counts, others = toxicity.train(spark, df, df.select("doc_id", "toxic"), usable=usable, limit=limit)
    counts = counts + toxicity.label_counts(toxicity._logits(spark, df, model, "doc_id", "text"), others)
    es = list(toxicity.COMMON).index("es")
    want = [r for r in rows if r[0] % 10 != 9]
    assert counts.sum() == len(want) and counts[es, :, 1].sum() == 20 and counts[es].sum() == sum(r[0] % 6 == 0 for r in want)
    got = toxicity.classify(spark, df, df.select("doc_id", "toxic"), usable=usable, limit=limit).collect()
    assert len(got) == 600 and np.mean([r.predicted == rows[r.doc_id][2] for r in got]) > 0.97


def test_mixing(spark):
    rows = [(i, ("the hat that was thin " if i % 4 else "ñandú año señor niño ") * 5, "en" if i % 4 else "es") for i in range(200)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix(spark, df, df.where("doc_id < 80").select("doc_id"), {"en": 0.5, "es": 0.5})
    r = out.agg(F.sum(F.col("expected") * F.col("p_es")).alias("es"), F.sum("n_tokens").alias("n"), F.min("rate").alias("low"), F.count("*").alias("k")).first()
    assert r.es / r.n == pytest.approx(0.5, abs=0.01) and r.low >= 0 and r.k == 201
    assert mixing.mix(spark, df.limit(0), df.select("doc_id"), {"en": 1.0}).isEmpty()


def test_mixing_posteriors_by_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("aeinst ñü" if i % 3 else "eehou wzß"), 30)), "es" if i % 3 else "de") for i in range(60)] + [(99, None, "de"), (100, "", None), (100, "ñ" * 50_000, "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.n_tokens, r.p_de) for r in mixing.mix(spark, df, df.where("doc_id < 40").select("doc_id"), {"de": 1.0, "es": 1.0}).collect())
    shares = np.array([[(t or "").lower().count(c) / max(len(t or ""), 1) for c in mixing.LETTERS] for _, t, _ in rows])
    known = [[k for k, r in enumerate(rows) if r[0] < 40 and r[2] == d] for d in ("de", "es")]
    spread = sum(len(k) * shares[k].var(axis=0) for k in known) / 40 + 1e-5
    logs = np.stack([np.log(len(k) / 40) - ((shares - shares[k].mean(axis=0)) ** 2 / spread / 2).sum(axis=1) for k in known], axis=1)
    p = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -50, 50)))
    want = sorted((r[0], len((r[1] or "").split()), x) for r, x in zip(rows, p, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


def test_mixing_meets_targets_of_rare_domains(spark):
    texts = {"en": "the hat that was thin ", "de": "über größe zwölf wozu zz ", "fr": "çà où être là ", "es": "ñandú año señor niño "}
    rows = [(i, texts[d] * 5, d) for i, d in enumerate(["en"] * 300 + ["de"] * 44 + ["fr"] * 44 + ["es"] * 12)]
    goal = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = mixing.mix(spark, df, df.select("doc_id"), goal)
    r = out.agg(F.sum("n_tokens").alias("n"), F.min("rate").alias("low"), *[F.sum(F.col("expected") * F.col(f"p_{d}")).alias(d) for d in goal]).first()
    assert all(r[d] / r.n == pytest.approx(g, abs=1e-3) for d, g in goal.items()) and r.low >= 0
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mix(spark, df.where("lang <> 'es'"), df.select("doc_id"), goal)


def test_html(spark):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>Head</h1><p><b>A&amp;B<br>c<p>d <i>e</i>f</p><div class="comments">me too</div></article><form><input value="x>y">Go</form><footer>&copy; me</footer></body></html>'
    assert html_extract.extract(page) == "Head A&B c d ef"
    assert html_extract.extract("") == "" and html_extract.extract("a < b</p></div>") == "a < b"
    rows = [(i, "http://h.org/x", page.replace("Head", f"Head{i}"), "x") for i in range(10)] + [(10, None, None, "x"), (3, "http://h.org/x", page.replace("Head", "Head3"), "x"), (11, "http://q.org", "<p>" + "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, tokens string")
    got = html_extract.main_text(spark, df).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == 13 and by_id[10] == "" and by_id[3] == "Head3 A&B c d ef" and len(by_id[11]) == 999_999
    assert html_extract.main_text(spark, df.limit(0)).isEmpty()


def test_html_template_decides_without_telling_names(spark):
    def words(k, n):
        return " ".join(f"{k}w{j}" for j in range(n))

    rows = [(i, "http://h.org/x", f"<body><div><div>Home</div><div>About us</div></div><div><a href=/{i}>see {i}</a> <a href=/b>also {i}</a></div><div><h2>Title {i}</h2><div>{words(i, 30)}</div></div><div>Copyright</div></body>") for i in range(12)]
    # Near copies of one article: what they share is no template.
    rows += [(100 + i, "http://n.org/x", f"<body><div><p>{words('same', 40)}</p><p>changed {i}</p></div></body>") for i in range(12)]
    # A passage in every article of a host stays.
    rows += [(200 + i, "http://p.org/x", f"<body><div>Top</div><article><p>{words(i, 40)}</p><p>the passage that repeats</p></article></body>") for i in range(12)]
    # Tokens in another order on some pages are no class.
    rows += [(300 + i, "http://o.org/x", f"<body><div><b>One</b><i>Two</i></div><p>{words(i, 20)}</p></body>" if i % 2 else f"<body><div><i>Two</i><b>One</b></div><p>{words(i, 20)}</p></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_text(spark, df).collect()}
    off = {r.page_id: r.text for r in html_extract.main_text(spark, df, min_pages=1000).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} {words(i, 30)}" and off[i].startswith("Home About us see") and off[i].endswith("Copyright")
        assert got[100 + i] == f"{words('same', 40)} changed {i}"
        assert got[200 + i] == f"{words(i, 40)} the passage that repeats"
        assert "Two" in got[300 + i]


def test_html_nesting():
    page = "<a1>x</a1><b1>y</b1><a1>x</a1>"
    key = {html_extract._key(p, t, k, i): t for p, t, k, i, _ in html_extract.walk(page)}
    outer, inner = (next(h for h, t in key.items() if t == x) for x in ("x", "y"))
    _, rows, _ = html_extract.shape_of(page, {outer: 1, inner: 2}, {1: 0, 2: 1})
    by_class = {r[0]: r for r in rows}
    assert by_class[2][2] == html_extract._hash("(1, 1)") and not by_class[1][3] and not by_class[2][3]
    _, rows, _ = html_extract.shape_of("<a1>x</a1><b1>y</b1><a1>x</a1><b1>y</b1>", {outer: 1, inner: 2}, {1: 0, 2: 1})
    assert {r[0]: r[3] for r in rows} == {1: False, 2: True}


def test_pipeline_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    words = lambda k: " ".join(f"{k}{i}" for i in range(20))
    rows = [(None, words("a")), (None, words("b")), (3, words("c")), (3, words("d")), (5, words("e")), (4, words("e")), (4, words("e")), (None, words("e")), (6, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert {(r.doc_id, r.text) for r in out} == {rows[i] for i in (0, 1, 2, 3, 5, 8)} and len(out) == 6

    def judge(spark, docs, labels, key_col="doc_id"):
        return docs.select(key_col, F.coalesce(F.col("text").rlike("^(b0|d0)"), F.lit(False)).cast("int").alias("predicted"))

    monkeypatch.setattr(corpus_pipeline, "classify", judge)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_toxic(spark, df, "").collect()} == {rows[i] for i in (0, 2, 4, 5, 7, 8)}


def test_clashing_columns_nulls_and_repeats(spark):
    """Every operator over rows of nulls, repeats, a long text and columns named like its own."""
    rows = [(None, None, None, None), (None, "the cat of the house and garden", None, None), (1, "the cat of the house and garden", "en", 1), (1, "the cat of the house and garden", "en", 1), (1, "", "es", 0), (2, "the word " * 20_000, "fr", 0), (3, "nasty words", "en", 1)]
    clash = ["words", "spans", "score", "s", "tokens", "host", "path", "key", "id", "logit", "n", "label", "sh", "p", "fold", "t", "a", "b", "v", "l"]
    df = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], "doc_id long, text string, lang string, toxic int, " + ", ".join(f"{c} string" for c in clash))
    labels = df.select("doc_id", "toxic", "text", "score")
    public = pytest.importorskip("public_tokenizers")
    n = {
        "license": license_scan.license_scan(df), "pii": pii.sanitise(spark, df), "mixing": mixing.mix(spark, df, labels, {"en": 1.0, "es": 1.0}), "fingerprints": fingerprints.fingerprints(spark, df),
        "tokens": token_counts.token_counts(df, public.path("byte_bpe_50k.json")), "toxicity": toxicity.classify(spark, df, labels), "ngrams": ngram_join.ngram_join(spark, df.where("doc_id is not null").dropDuplicates(["doc_id"])),
        "urls": url_filter.url_filter(spark, df, url_col="text", id_col="doc_id"), "html": html_extract.main_text(spark, df, url_col="host", html_col="text", id_col="doc_id"),
    }
    counts = {k: x.count() for k, x in n.items()}
    assert counts.pop("ngrams") == 3 and set(counts.values()) == {len(rows)}
    same = n["toxicity"].where("doc_id = 1").collect()
    assert len(same) == 3 and len({r.score for r in same}) <= 2
    items = spark.createDataFrame([(7, "cat of the house and garden", "x"), (None, None, "x")], "item_id long, text string, words string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(spark, df, items).collect()} == {(1, 7), (None, 7)}
    none = df.limit(0)
    assert toxicity.classify(spark, none, labels).isEmpty() and url_filter.url_filter(spark, none, url_col="text", id_col="doc_id").isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(400)], 40)) for _ in range(400)]
    for k in range(0, 400, 5):
        texts[k] += " vile nasty vile nasty"
    item = " ".join(f"q{i}" for i in range(30))
    texts[1] += " " + item
    texts[3] = texts[2]  # copies: one stays
    texts[4] += " call +1 (988) 555-2485"
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (None, "a text without an id", None, None, None), (7, "another text of one id", "en", "s", 22)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {name: {r.doc_id for r in x} for name, x in kept.items()}
    assert ids["toxicity"] == {i for i in range(400) if i % 5} | {None} and len(kept["toxicity"]) == 323
    assert ids["near_duplicates"] == ids["toxicity"] - {3} and {1} == ids["near_duplicates"] - ids["decontamination"]
    clean = {r.doc_id: r.text for r in kept["personal_data"] if r.doc_id == 4}
    assert clean[4].endswith("call [PHONE]") and len(kept["personal_data"]) == len(kept["decontamination"]) == len(kept["mixing"]) == 321
    assert {"another text of one id", "a text without an id"} <= {r.text for r in kept["personal_data"]}
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).isEmpty()
