"""Languages that a sample over all rows would miss."""

import math
import random

from pyspark.sql import functions as F

from driftlens.llm import langid
from tests.llm.test_llm import documents


def test_rare_languages(spark):
    rng = random.Random(3)
    make = {"en": "the of and tion ing that with er ".split(), "de": "der die und sch ung keit für über ".split(), "el": "και του της ση που για ".split(), "ka": ["და", "რომ", "არის", "ის"]}
    text = lambda l, n: " ".join("".join(rng.choices(make[l], k=2)) for _ in range(n))
    rows = [(i, text("de" if i % 2 else "en", 12), "de" if i % 2 else "en", f"s{i % 3}") for i in range(3000)]
    rows += [(5000 + i, text("el", 60), "el", "s1") for i in range(6)]  # 0.2 % of all rows
    rows += [(6000, text("ka", 42), "ka", "s1")]  # too little for a model
    rows += [(7000, text("el", 60), None, "s1")]
    rows += [(8000, " ".join("".join(rng.choices("qxzjkvw", k=9)) for _ in range(80)), None, "s1")]
    got = {r.doc_id: r for r in langid.report(documents(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i].keep and got[i].lang == "el" for i in [*range(5000, 5006), 7000])
    assert got[6000].keep and not got[8000].keep
    assert sum(got[i].lang == rows[i][2] for i in range(3000)) >= 2990
    # a text that repeats counts once in the sample
    again = langid.train(documents(spark, rows + [rows[0]] * 50), rows=40)
    once = langid.train(documents(spark, rows), rows=40)
    assert again.languages == once.languages and (again.table == once.table).all()


def test_fusion_on_pages(spark):
    """Markup, host, parent domain and address suffix together, where texts say nothing."""
    rng = random.Random(4)
    make = {"en": "the of and tion ing that with er ".split(), "de": "der die und sch ung keit für über ".split()}
    text = lambda l, n: " ".join("".join(rng.choices(make[l], k=2)) for _ in range(n))
    rows = [(i, f"https://h{i % 4}.{l}site.{'de' if l == 'de' else 'uk'}/{i}", f'<html lang="{l}">', text(l, 30)) for i, l in enumerate(["en", "de"] * 100)]
    rows += [(900, "https://new.desite.de/", "<html>", ""), (901, "https://new.ensite.uk/", "<html>", ""), (902, "https://a.other.de/", "<html>", ""), (903, "https://a.other.uk/", "<html>", ""), (904, None, '<html lang="DE">', None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("said", langid.declared_of(F.col("html")))
    got = {r.page_id: r.langid for r in langid.identified(pages, declared="said", host=langid.host_of(F.col("url")), key="page_id").collect()}
    assert len(got) == len(rows) and [got[i].lang for i in range(900, 905)] == ["de", "en", "de", "en", "de"] and all(x.keep for x in got.values())


def test_posterior_against_plain_product(spark):
    """Every factor counted and multiplied in plain Python; a clashing column is replaced."""
    rng = random.Random(6)
    make = {"en": "the of and tion ing that with er ".split(), "de": "der die und sch ung keit für über ".split()}
    text = lambda l, n: " ".join("".join(rng.choices(make[l], k=2)) for _ in range(n))
    rows = [(i, f"https://{'a' if i % 3 else 'b'}.{l}.{'de' if l == 'de' else 'uk'}/", rng.choice([l, l, None, "en"]), text(l, rng.choice([1, 2, 20]))) for i, l in enumerate(["en", "de"] * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, said string, text string").withColumn("langid", F.lit("clash"))
    found = langid.identified(pages, declared="said", host=langid.host_of(F.col("url")), key="page_id")
    assert found.columns == ["page_id", "url", "said", "text", "langid"]
    got = {r.page_id: r.langid for r in found.collect()}
    model = langid.train(pages, "text", "said")
    names = model.languages
    n = len(names)

    def by_text(t):
        data = [langid.FOLD[b] for b in (" " + t + "  ").encode()] + [32, 32]
        out = [0.0] * n
        for a, b, c in zip(data, data[1:], data[2:]):
            if b == 32 and 32 in (a, c):
                continue
            k = (((int(a) * 0x01000193 ^ int(b)) * 0x01000193 ^ int(c)) * 0x9E3779B1 % 2**32) >> 17
            for i in range(n):
                out[i] += model.table[i][k] / langid.TEMPER
        return out

    def by_claim(said):
        return [0.0 if said is None else -math.log(n - 1) if x == "und" else math.log(langid.TRUST if x == said else (1 - langid.TRUST) / (n - 2)) for x in names]

    first = {}
    for i, _, said, t in rows:
        logs = [a + b for a, b in zip(by_text(t), by_claim(said))]
        logs[-1] += math.log(langid.UND_PRIOR)
        first[i] = logs.index(max(logs))
    host = {i: u.split("/")[2] for i, u, *_ in rows}

    def smoothed(keep, towards):
        c = [sum(first[i] == k for i in first if keep(host[i])) for k in range(n)]
        return [(x + langid.STRENGTH * p) / (sum(c) + langid.STRENGTH) for x, p in zip(c, towards)]

    everything = smoothed(lambda h: True, [(1 - langid.UND_PRIOR) / (n - 1)] * (n - 1) + [langid.UND_PRIOR])
    for i, _, said, t in rows:
        h = host[i]
        parent = smoothed(lambda x: x.split(".", 1)[1] == h.split(".", 1)[1], everything)
        own = smoothed(lambda x: x == h, parent)
        suffix = smoothed(lambda x: x.rsplit(".", 1)[1] == h.rsplit(".", 1)[1], everything)
        logs = [a + b + math.log(c) + math.log(d / e) for a, b, c, d, e in zip(by_text(t), by_claim(said), own, suffix, everything)]
        p = [math.exp(x - max(logs)) for x in logs]
        best = max(range(n - 1), key=lambda k: p[k])
        assert got[i].lang == names[best] and abs(got[i].posterior - p[best] / sum(p)) < 1e-5
