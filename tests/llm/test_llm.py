"""The ten operators on small fixtures: brute force, round trips, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, hnsw, jaccard_join, main_text, packing, quality_model, quality_rules, shuffle_shards, toxicity, warc

ODD = ["", "   ", "a", "a b c", "x " * 400, "Word, word.\n\nWord, word.\n", "É ß 日本 😀", None, "A b c d e f g", "a B c d e f g", "a b c d e f g h i j k l m"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def odd_docs(spark):
    return spark.createDataFrame([(i % 9, t, None if i == 3 else "en", None, None, "clash", "clash") for i, t in enumerate(ODD + ODD[:3])], DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def near(rnd, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
    return " ".join(w)


# --- 1


def test_main_text():
    page = "<html><body><nav><a href=/>Home page</a></nav><div class='ad'>Buy now many things</div><article><h1>Big &amp; small</h1><p>One <b>t</b>wo&nbsp;three<br>four words stand here and there.<div class=comment><p>I hate it</div><script>x()</script><p>Last one is also here.</article><footer>(c) us</footer></body></html>"
    assert main_text.main_text(page) == "Big & small One two three four words stand here and there. Last one is also here."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p") == ""
    for html, mark in main_text.labelled_pages(60, seed=77):
        want = [w for w in re.sub(r"<[^>]*>", " ", html).split() if w.startswith(mark)]
        got = main_text.main_text(html).split()
        assert len(set(got) & set(want)) >= 0.6 * len(want)


def test_main_text_keeps_every_marked_word_and_no_other():
    for html, mark in main_text.labelled_pages(150, seed=78):
        want = [w for w in re.sub(r"<[^>]*>", " ", html).split() if w.startswith(mark)]
        assert main_text.main_text(html).split() == want, html
    body = "<p>Some <a href=/y>linked words</a> and <ins>added ones</ins> of the text.</p><p>It ends in a line with its <a href=/z>last link</a></p>"
    text = "Some linked words and added ones of the text. It ends in a line with its last link"
    for page in (f"<body>{body}<footer>us</footer></body>", f"<body><article>{body}<ins class=adsbygoogle>Buy</ins></article></body>"):
        assert main_text.main_text(page) == text
    for holder in ("main", "div id=content", "div class=entry", "article"):
        for head in ("header", "header class=page-header"):
            page = f"<body><header>Site</header><{holder}><{head}><h1>Big title</h1></header>{body}</{holder.split()[0]}></body>"
            assert main_text.main_text(page) == "Big title " + text, page


#: Pages written by hand, apart from the generator that the weights are learned from: (html, the article's text).
BY_HAND = [
    ("""<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href=/>Daily</a></header><nav class="main-nav"><ul><li><a href=/1>World</a><li><a href=/2>Sport</a></ul></nav>
<main><article class="post"><header><h1>Storm &amp; flood</h1></header><p>Rain fell on <em>Tuesday</em> night,   and the river rose by two metres.</p><figure><img src=x><figcaption>The old bridge, seen from the mill.</figcaption></figure>
<aside class="related"><h3>Read more</h3><ul><li><a href=/3>Another storm</a></li></ul></aside><p>Nobody was hurt, the mayor said; the <a href=/m>mill</a> stays shut.</p></article></main><section id="comments"><p>First! What a great story that was to read.</p></section><footer>&copy; Daily 2020</footer></body></html>""",
     "Storm & flood Rain fell on Tuesday night, and the river rose by two metres. The old bridge, seen from the mill. Nobody was hurt, the mayor said; the mill stays shut."),
    ("""<body><div id="cookie-banner" class="cookie">We use cookies to improve what you see here.</div><div id=content><h1>Proof</h1><p>We know that <math><mi>x</mi><mo>&lt;</mo><mn>3</mn></math> holds for all of these numbers.</p><p>So the sum <svg><text>S</text></svg> is finite, as we wanted to show.</p><form action=/s><label>Search</label><select><option>All<option>None</select><button>Go</button></form></div><div id="sidebar"><p>About the author of this page and others.</p></div>""",
     "Proof We know that x<3 holds for all of these numbers. So the sum S is finite, as we wanted to show."),
    ("""<html><body><div class="menu"><a href=a>One</a> | <a href=b>Two</a></div><div class="entry"><h2>Bread</h2><ol><li>Mix flour and water well.<li>Wait for an hour or two.<li>Bake until it is brown.</ol><table><tr><th>Flour<td>500 g<tr><th>Water<td>350 g</table><pre>bake  --hot</pre><div class="share social"><a href=t>Tweet</a></div><p>Enjoy it while it is warm&hellip;</div><div class="comments"><div class="comment"><p>Mine burned, sadly enough for all of us.</p></div></div>""",
     "Bread Mix flour and water well. Wait for an hour or two. Bake until it is brown. Flour 500 g Water 350 g bake --hot Enjoy it while it is warm…"),
    ("""<body><article><h1>Half a page</h1><p>It is cut off in the middle of a sen""", "Half a page It is cut off in the middle of a sen"),
    ("""<body><noscript>Please turn on scripts to see this page.</noscript><main><p>One two three four five.<script>if (a < b) { document.write("<p>no") }</script><p>Six seven <!-- <p>hidden --> eight nine ten.<textarea>typed</textarea><iframe>frame</iframe></main>""", "One two three four five. Six seven eight nine ten."),
]


def test_pages_written_by_hand():
    for page, text in BY_HAND:
        assert main_text.main_text(page) == text, page


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        for one in ("<b>x ", "<div><p>x ", "<b>x</i></q> ", "<b><div>x</div><li>"):
            main_text.main_text("<body><article>" + one * n)
        return time.perf_counter() - began

    main_text.trained()
    seconds(100)
    assert seconds(16_000) < 25 * seconds(2_000)  # eight times the length
    assert main_text.main_text("<body><article><p>" + "word " * 300_000) == ("word " * 300_000).strip()


def test_main_text_rows(spark):
    page = BY_HAND[0][0]
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (None, None, None, None), (3, "u", "", "x"), (4, "u", "<p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "text"] and sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, BY_HAND[0][1]), (1, BY_HAND[0][1]), (3, ""), (4, "")]
    assert main_text.extract_main_text(df.limit(0)).count() == 0


def test_best_region_is_the_best():
    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.choice([-2, -1, 1, 2]) for _ in range(rnd.randint(1, 12))]
        best = max((sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)), default=0)
        got = main_text.best_region(s)
        assert (sum(s[got[0] : got[1] + 1]) if got else 0) == max(best, 0)


# --- 2


def test_quality_rules(spark):
    out = quality_rules.quality_cascade(odd_docs(spark), stats=True).collect()
    assert len(out) == len(ODD) + 3 and quality_rules.quality_cascade(empty_docs(spark)).count() == 0
    for r in out:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        assert r.n_repeat_words == len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)})
    texts = ["a b c " * 30, "short"] * 10
    order = quality_rules.order_rules(quality_rules.RULES, [t.encode() for t in texts])
    assert [e.gain for e in order] == sorted((e.gain for e in order), reverse=True) and len(order) == len(quality_rules.RULES)


def test_op2_query_on_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = quality_rules.op2_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert {r.n_words for r in got} == {len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ODD}


# --- 3 and 10


def labelled(spark, n=400):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(60)]
        toxic, poor = int(i % 3 == 0), int(i % 5 == 0)
        words = [re.sub(r"\d", lambda m: chr(97 + int(m[0])), w) for w in words]
        if toxic:
            words[7] = "nasty" + rnd.choice(["er", "est", "ly"])
        if poor:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1 - poor, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_texts(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").filter(toxicity.fold("doc_id") == 2).collect()
    hits = [r.score for r in got if r.label]
    rest = [r.score for r in got if not r.label]
    assert np.mean([a > b for a in hits for b in rest]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = toxicity.score_texts(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 3 and all(r.score is not None for r in odd) and toxicity.score_texts(empty_docs(spark), model).count() == 0
    long = "word " * 200_000 + "nastyer"
    assert model.scores([long])[0] > model.scores(["word " * 1000])[0]  # read to the end


def test_toxicity_learns_from_every_labelled_row_and_to_its_end(spark):
    rnd = random.Random(8)
    order = spark.range(5200).filter(toxicity.fold("id").isin(0, 1)).orderBy(F.xxhash64(F.lit(17), "id"), "id").collect()
    late = {r.id for r in order[2000:]}  # past what a sample of 2,000 a class would hold
    filler = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    rows = [(i, filler(12) + (" vile" if i in late else " nasty"), 1) for i in range(5200)] + [(i, filler(13), 0) for i in range(6000, 7500)]
    rows += [(i, "plain " * 17_000 + ("foul" if i % 2 else "fair"), i % 2) for i in range(8000, 8160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    vile, foul, fair, clean = model.scores([filler(12) + " vile", "plain " * 50 + "foul", "plain " * 50 + "fair", filler(13)])
    assert vile > 0.5 > clean and foul > 0.5 > fair


def test_shards_learn_the_same_whatever_the_partitions(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 15_000)
    one, two = toxicity.fit(docs.coalesce(1), labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(one.embed, two.embed) and np.array_equal(one.taps, two.taps) and (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)
    held = docs.filter(toxicity.fold("doc_id") == 2).join(labels, "doc_id").collect()
    s, y = one.scores([r.text for r in held]), np.array([r.toxic for r in held])
    assert np.mean(s[y == 1][:, None] > s[y == 0]) > 0.95


def test_quality_model(spark):
    docs, labels = labelled(spark)
    model = quality_model.fit(docs, labels, skip_fold=2)
    assert list(model.cuts) == sorted(model.cuts)
    got = quality_model.grade_texts(docs, model).join(labels, "doc_id").filter(toxicity.fold("doc_id") == 2).collect()
    good, bad = [r.tail_probability for r in got if r.quality], [r.tail_probability for r in got if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert quality_model.grade_texts(odd_docs(spark), model).count() == len(ODD) + 3


def test_classifiers_without_labels_or_with_one_class_and_other_odd_tables(spark):
    docs, labels = labelled(spark, 90)
    odd = odd_docs(spark).withColumn("toxic", F.lit("clash")).withColumn("expected_grade", F.lit("clash")).withColumn("selected", F.lit(1))
    for own in (labels.limit(0), labels.filter("toxic = 0 and quality = 1"), labels.select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic")):
        for fit, run in ((toxicity.fit, toxicity.score_texts), (quality_model.fit, quality_model.grade_texts)):
            model = fit(docs, own)
            got = run(odd, model)
            assert got.count() == len(ODD) + 3 and run(empty_docs(spark), model).count() == 0
            assert len(set(got.columns)) == len(got.columns) and [f for f in got.schema if f.name in ("toxic", "selected")][-1].dataType.typeName() == "boolean"
    twice = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit(None).cast("string")))
    texts, y, _ = toxicity.labelled_sample(twice, labels.unionByName(labels.withColumn("toxic", F.lit(0))), [0, 1, 3], 500)
    assert len(texts) == len(y) <= 90 and y.sum() > 0 and any(texts)


def test_op3_and_op10_columns(spark, tmp_path):
    docs, labels = labelled(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", "en", "s", 1), (5000, None, None, None, None)], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op3_toxicity(spark, str(tmp_path))
    assert dict(got.dtypes)["held_out"] == "boolean" and dict(got.dtypes)["score"] == "double" and dict(got.dtypes)["predicted"] == "int"
    rows = got.collect()
    assert len(rows) == 202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    again = {(r.doc_id, r.score) for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}
    graded = quality_model.op10_quality_model(spark, str(tmp_path)).collect()
    assert len(graded) == 202 and all(0 <= r.expected_grade <= 2 and r.selected == (r.tail_probability >= 0.5) for r in graded)


# --- 4


def test_shuffle_shards(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("text"))
    for table in (docs, docs.unionByName(docs.filter("doc_id < 5"))):
        out = shuffle_shards.shuffle_into_shards(table, 24, bucket_bytes=4000).select("record.doc_id", "shard", "slot").collect()
        assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in table.collect())
        per = {}
        for r in out:
            per.setdefault(r.shard, []).append(r.slot)
        assert set(per) == set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in per.values())
    again = shuffle_shards.shuffle_into_shards(docs, 24, bucket_bytes=4000).select("record.doc_id", "shard", "slot")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, shuffle_shards.shuffle_into_shards(docs, 24, bucket_bytes=4000).select("record.doc_id", "shard", "slot").collect()))
    assert shuffle_shards.shuffle_into_shards(docs.limit(0)).count() == 0 and shuffle_shards.shuffle_into_shards(docs.limit(3)).count() == 3


def shards_by_hand(docs, places):
    """doc_id -> (shard, slot): scatter, Fisher-Yates, cut, in plain Python."""
    num = lambda *what: int(hashlib.md5(":".join(map(str, what)).encode()).hexdigest()[:15], 16)
    size = sum(len((t or "").encode()) + 64 for _, t in docs)
    buckets = max(1, -(-size // shuffle_shards.BUCKET_BYTES), -(-len(docs) // shuffle_shards.BUCKET_ROWS))
    held = [[] for _ in range(buckets)]
    for (i, _), p in zip(docs, places, strict=True):
        held[num(11, p) % buckets].append((hashlib.md5(f"11:{p}".encode()).hexdigest(), i))
    line = []
    for b, rows in enumerate(held):
        rows.sort()
        for k in range(1, len(rows)):
            j = num(11, b, k) % (k + 1)
            rows[k], rows[j] = rows[j], rows[k]
        line += [i for _, i in rows]
    out, at = {}, 0
    for shard in range(24):
        n = len(docs) // 24 + (shard < len(docs) % 24)
        out |= {i: (shard, k) for k, i in enumerate(line[at : at + n])}
        at += n
    return out


def test_op4_is_the_same_whatever_the_partitions(spark, tmp_path):
    docs = [(i, None if i % 50 == 0 else "é word " * (i % 9)) for i in range(5000)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    file = next((tmp_path / "documents.parquet").glob("*.parquet")).name
    found, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            found.append(sorted(map(tuple, shuffle_shards.op4_shuffle_shards(spark, str(tmp_path)).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]
    want, texts = shards_by_hand(docs, [f"{file}:{i}" for i in range(5000)]), dict(docs)
    for i, size, crc, law, shard, slot, grown in found[0]:
        raw = (texts[i] or "").encode()
        assert (size, crc, law, (shard, slot), grown) == (len(raw) + 8, zlib.crc32(raw), "rows", want[i], None)
    shuffle_shards.write_shards(shuffle_shards.shuffle_into_shards(spark.createDataFrame(docs, "shard long, text string"), 24), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5000 and back.select("record.shard").distinct().count() == 5000


# --- 5


def test_nearest(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(900, 16)).round(4)
    x[300:420] = x[7]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.search(df.filter("vec_id % 50 = 0"), hnsw.build_index(df, shards=3)).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(900), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hit += len(set(want) & {r.vec_id for r in mine})
    assert hit >= 0.9 * 5 * 18 and {r.query_id for r in got} == set(range(0, 900, 50))
    assert hnsw.search(df.limit(0), hnsw.build_index(df.limit(0))).count() == 0


# --- 6


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join(spark):
    rnd = random.Random(8)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for c in range(40):
        words = [f"c{c}w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 6, 20, 90, 300]))] + (passage if c % 2 else [])
        rows += [near(rnd, words, rnd.randint(0, max(0, len(words) // 25))) for _ in range(rnd.choice([1, 2, 3, 25]))]
    rows += ODD + rows[:5]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_a_text_without_an_id_links_documents(spark):
    w = [f"w{i}" for i in range(40)]
    a, b, c = w, [*w[:-4], "x1", "x2", "x3", "x4"], ["y1", "y2", "y3", "y4", *w[4:-4], "x1", "x2", "x3", "x4"]
    ends = brute_components([(1, " ".join(a)), (2, " ".join(c))])
    assert ends[2][1] == 2 and brute_components([(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(b))])[2][1] == 1
    rows = [(1, " ".join(a)), (2, " ".join(c)), (None, " ".join(b)), (None, " ".join(b)), (None, "one of its own"), (None, None)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1)]
    assert sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0, 0, 1, 1]


def test_jaccard_join_with_any_column_names(spark):
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "fp long, kind string, n int, last int, bucket int")
    got = {r.fp: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df, "fp", "kind").collect()}
    assert got == brute_components(list(enumerate(ODD)))


def test_hot_keys_take_the_broadcast_way(spark):
    from weftline.llm.common import join_counted

    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("rows"))
    got = join_counted(big, small, "k", "rows").select("id", "rows").collect()
    assert sorted((r.id, r["rows"]) for r in got) == [(i, 1 if i % 3 else 1000) for i in range(3000)]


# --- 7


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib, own, rnd = Tokenizer.from_file(path), bpe.load(path), random.Random(4)
    parts = ["a", " ", "  ", "\n", "'s", "é", "日本", "😀", " ", "　", "12", "<|endoftext|>", "the", "!!", "́", "\r\n", "x" * 90, "\x00"]
    for _ in range(800):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20)))
        want = lib.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == np.array(want, "<u4").tobytes()
        assert own.decode(own.encode(s)) == lib.decode(want, skip_special_tokens=False).encode()
    coded = bpe.bpe_decode(bpe.bpe_encode(odd_docs(spark), path), path).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in coded)


def test_bpe_remembers_frequent_words_and_merges_alike_both_ways():
    asked = []
    own, rnd = bpe.load(bpe.default_vocabulary()), random.Random(6)
    memory = bpe.Remembered(lambda k: asked.append(k) or k, 20)
    for i in range(200):
        assert memory["often"] == "often" and memory[str(i)] == str(i) and memory["x" * 64] == "x" * 64
    assert asked.count("often") == 1 and len(memory) + len(memory.older) <= 20
    for _ in range(300):
        raw = bytes(rnd.choice(b"abeinrst .\xc3\xa9") for _ in range(rnd.randint(1, 60)))
        assert own.merge(raw) == own.merge_long(raw)


def test_op7_query_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t in enumerate(ODD + ODD[:3]):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i % 9, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.op7_bpe(spark, str(tmp_path)).collect())) == sorted(want)
    clash = odd_docs(spark).withColumn("ids", F.lit("clash"))
    assert bpe.bpe_encode(clash, bpe.default_vocabulary()).count() == len(want) and bpe.bpe_encode(clash.limit(0), bpe.default_vocabulary()).count() == 0


# --- 8


def test_packing(spark):
    rnd = random.Random(6)
    rows = [(i, None if i == 3 else "tok " * rnd.choice([0, 3, 50, 700, 1365, 2000, 5000]) + f"end {i}") for i in range(300)]
    rows += [(i + 1000, "same text " * 200) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df).collect()
    per = {}
    for r in out:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in per.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in out)
    assert len(per) <= 1.02 * -(-total // 4096) + 1
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_vocabulary())
    for i, t in rows[:40]:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == i)
        assert own == [(p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plans_place_every_piece_once_and_patterns_carry_their_share():
    rnd = np.random.default_rng(2)
    for lengths in (rnd.integers(1, 4097, 3000), np.full(500, 700), rnd.integers(1, 60, 2000), np.exp(rnd.normal(6, 1, 20_000)).astype(int).clip(1, 4096), np.array([4096, 1, 1]), np.array([], int)):
        counts = np.bincount(lengths, minlength=4097)
        plan = packing.best_plan(counts)
        each = np.sort(lengths)
        rank = np.arange(len(each)) - np.searchsorted(each, each)
        to = plan.sequence_of(each, rank) if len(each) else each
        filled = np.bincount(to, weights=each, minlength=plan.sequences)
        assert len(filled) == plan.sequences and (filled > 0).all() and filled.max(initial=0) <= 4096
        alone = packing.Plan(counts, phases=())  # best fit alone
        assert plan.sequences <= 1.005 * alone.sequences
        if len(each) > 2500:  # many lengths
            assert plan.patterned_tokens >= 0.08 * each.sum()


def test_packing_equal_rows_and_clashing_names(spark):
    rows = [(5, "x " * 900)] * 7 + [(None, None), (None, ""), (6, "y " * 9000)]
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in rows], "piece long, start string, length int, salt int, rank int, text int")
    out = packing.pack_documents(df, key="piece", text="start").toDF("id", "piece", "start", "length", "crc", "sequence", "offset").collect()
    assert sorted((r.id or 0, r.piece, r.start, r.length) for r in out) == sorted([(5, 0, 0, 901)] * 7 + [(0, 0, 0, 1)] * 2 + [(6, 0, 0, 4096), (6, 1, 4096, 4096), (6, 2, 8192, 809)])
    spans = sorted((r.sequence, r.offset, r.length) for r in out)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in itertools.pairwise(spans)) and len({(s, o) for s, o, _ in spans}) == len(out)


# --- 9


def test_warc(spark, tmp_path):
    rows = [(i, None if i == 2 else f"http://e/{i}", None if i == 4 else f"<p>{i % 6}é{'x' * 3000}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path))
    back = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert len(back) == 30
    first = {}
    for i, url, html in rows:
        raw = (html or "").encode()
        r = back[f"urn:weftline:page:{i}"]
        assert r.target_uri == url and r.payload_bytes == len(raw) and r.payload_digest == warc.base32_sha1(raw)
        if raw in first:
            assert r.record_type == "revisit" and r.refers_to == f"urn:weftline:page:{first[raw]}" and r.payload is None
        else:
            first[raw] = i
            assert r.record_type == "response" and bytes(r.payload) == raw
    some = warc.read_archives(spark, str(tmp_path), payload=False).filter("record_type = 'revisit' and payload_bytes > 100")
    assert some.count() == 30 - len(first) - 0 and "record_type" in some._jdf.queryExecution().toString()
    import glob
    import gzip

    whole = b"".join(gzip.open(p).read() for p in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 30  # any gzip reader can read them
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_overwrite_small_payloads_and_other_producers(spark, tmp_path, monkeypatch):
    rows = [(None, "u", "same long text"), (7, "u", "same long text"), (9, None, "same long text"), (1, "u", "ab"), (2, "u", "ab"), (None, "u", "alone"), (None, "u", "alone"), (3, "u", ""), (4, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (warc.BROADCAST_BYTES, 0):  # both ways to join
        monkeypatch.setattr(warc, "BROADCAST_BYTES", limit)
        warc.write_archives(df, str(tmp_path / "w"), least_bytes=3, mode="overwrite")
        back = warc.read_archives(spark, str(tmp_path / "w")).collect()
        kinds = sorted((r.record_id[18:], r.record_type, (r.refers_to or "")[18:], r.payload_bytes) for r in back)
        want = [("7", "response", "", 14), ("9", "revisit", "7", 14), ("", "revisit", "7", 14), ("1", "response", "", 2), ("2", "response", "", 2), *[("", "response", "", 5)] * 2, ("3", "response", "", 0), ("4", "response", "", 0)]
        assert kinds == sorted(want)
    assert not list((tmp_path / "w").glob("*.tmp"))
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    foreign = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    import gzip

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(foreign * 3)
    (tmp_path / "f" / "b.warc.gz").write_bytes(gzip.compress(foreign) * 2)
    got = warc.read_archives(spark, str(tmp_path / "f")).filter("payload_bytes = 5 and record_type = 'response'").collect()
    assert len(got) == 5 and all(bytes(r.payload) == b"hello" and r.record_id == "urn:x" and r.payload_digest is None for r in got)


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    docs, labels = labelled(spark, 240)
    long = docs.withColumn("text", F.concat("text", F.lit(" "), F.reverse("text")))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    copies = long.filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 10_000)
    long.unionByName(copies).write.parquet(str(tmp_path / "documents.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    clean = {i for i in range(240) if i % 3 and i % 5}
    assert ids <= {i for i in range(240) if i % 5} and len(ids & clean) >= 0.97 * len(clean) and not any(i >= 10_000 for i in ids)


def test_toxicity_stage_goes_by_the_thresholds_of_languages(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    docs, labels = labelled(spark, 120)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = toxicity.fit(docs, labels)
    model.thresholds = {"en": 2.0, "de": -1.0}
    monkeypatch.setattr(C, "fit", lambda *a: model)
    assert {r.doc_id for r in C.toxicity(spark, docs, str(tmp_path)).collect()} == set(range(0, 120, 2))


def test_toxicity_stage_learns_from_every_fold(spark, tmp_path):
    import corpus_pipeline as C

    rnd = random.Random(11)
    filler = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    # Each fold has a toxic word of its own; the language "xx" is labelled outside fold 3 only.
    own = ["nasty", "vile", "foul", "rotten"]
    rows = [(i, filler(12) + (f" {own[fold(i)]}" if i % 2 else ""), "xx" if fold(i) != 3 and i % 5 == 0 else "en", "s", 1) for i in range(1600)]
    rows += [(5000 + k, filler(12) + f" {w}", "en", "s", 1) for k, w in enumerate([*own, "plain"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1600)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.doc_id for r in C.toxicity(spark, docs, str(tmp_path)).filter("doc_id >= 5000").collect()} == {5004}
    model = toxicity.fit(docs, labels, True)
    assert set(model.thresholds) == {"en", "xx"}
    s, y = model.scores([r[1] for r in rows[:1600]]), np.arange(1600) % 2
    assert abs(s.mean() - 0.5) < 0.05 and np.mean(s[y == 1][:, None] > s[y == 0]) > 0.99
    # Too few labels for a half to hold both classes: the model still learns, uncalibrated.
    few = toxicity.fit(docs, labels.filter(f"doc_id in ({next(i for i in range(1, 99, 2) if fold(i) < 2)}, {next(i for i in range(0, 99, 2) if fold(i) >= 2)})"), True)
    assert few.thresholds is None and (few.slope, few.offset) == (1.0, 0.0)


def test_near_duplicate_stage_keeps_other_texts_under_one_id(spark):
    import corpus_pipeline as C

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(7, a), (3, a), (7, b), (3, a), (8, b + " end"), (None, a), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "") for r in C.near_duplicate(spark, docs.repartition(4), "").collect()))
    assert got == sorted([(3, a), (7, b), (0, a), (0, a), (5, ""), (5, "")])


def test_packing_ids_are_the_librarys():
    import random

    from tokenizers import Tokenizer

    from weftline.llm import packing

    path = packing.default_vocabulary()
    whole, ours = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    whole.no_truncation()
    whole.no_padding()
    rnd = random.Random(4)
    parts = list("abzABZéÉßÿÄ×÷ªºµ'.,!?;:&%#*$|<> \n\t\x85\xa0019İΣς你_-") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't"]
    texts = ["", " ", "É!!\n", *("".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(3000))]
    for text, got in zip(texts, ours.encode(texts), strict=True):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_merged_groups_keep_every_pair(spark):
    from itertools import combinations

    from weftline.llm.jaccard_join import merged

    groups = {1: [1, 2, 3], 2: [2, 3, 4, 5], 3: [5, 6], 4: [7, 8], 5: [7, 8]}
    got: dict[int, set] = {}
    for r in merged(spark.createDataFrame([(g, f, f) for g, own in groups.items() for f in own], "g long, fp long, label long")).collect():
        got.setdefault(r.g, set()).add(r.fp)
    assert all(any({a, b} <= own for own in got.values()) for members in groups.values() for a, b in combinations(members, 2))
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4, 5, 6], [7, 8]]
