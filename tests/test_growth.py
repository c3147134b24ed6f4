"""What grows with the input stays out of the driver and of single tasks; plans and sizes say so."""

from pyspark.sql import functions as F

from pagegrain.operators import search


def _plan(df):
    df.collect()  # the plan that ran
    return df._jdf.queryExecution().toString()


def test_same_members_gathers_neither_side(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    for one, two, same in (((), (), True), (("a", "a", None), (None, "a"), True), (("a",), ("a", None), False), (("a", "b"), ("a",), False), (("a",), (), False)):
        got = search.same_members(rows(*one), rows(*two).withColumnRenamed("name", "other"))
        assert [r.same for r in got.collect()] == [same]
    big = spark.range(1000).select((F.col("id") % 3).cast("string").alias("name"))
    assert "Join" not in _plan(search.same_members(big, big))


def test_asof_makes_few_ranges_of_little(spark, monkeypatch):
    from pagegrain.operators import asof

    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    made, cut = [], type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, n, *order: made.append(n) or cut(self, n, *order))
    monkeypatch.setattr(asof, "SMALL_RANGES", 20)
    found = asof.asof(spark, rows, rows.where("v % 10 = 0"), "k", "at", range_rows=10)
    assert found.count() == 2000 and found.where("found is null or found.v <= at and at - found.v < 30").count() == 2000
    assert made == [20]


def test_ways_into_circles_end_early(spark, monkeypatch):
    from pagegrain.operators import linking

    tables, kept = [], linking.written
    monkeypatch.setattr(linking, "written", lambda s, df, name: tables.append(name) or kept(s, df, name))
    moves = {**{i: i + 1 for i in range(20)}, 30: 31, 31: 32, 32: 30, 40: 41, 41: 30, 42: 40, 50: 51}
    rows = spark.createDataFrame([(a, "s", b, "s") for a, b in moves.items()], "doc bigint, slug string, to_doc bigint, to_slug string")

    def end(x, n=0):
        return end(moves[x], n + 1) if x in moves and n < 99 else (None if x in moves else x)

    assert {r.doc: r.to_doc for r in linking.settled(spark, rows).collect()} == {a: end(a) for a in moves}
    assert len(tables) < 12


def test_pages_become_objects_a_few_at_a_time():
    import pyarrow as pa

    from pagegrain.operators import extraction

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(250)), "url": ["http://a/"] * 250, "html": [f"<p>text {i}</p>" for i in range(250)]})
    for run in (extraction._extracted, extraction._with_source):
        found = list(run([batch]))
        assert max(map(len, found)) <= 100
        assert [r["page_id"] for b in found for r in b.to_pylist()] == list(range(250))
    assert all(r["markdown"].strip() == f"text {r['page_id']}" and r["html"] == f"<p>{r['markdown'].strip()}</p>" for b in found for r in b.to_pylist())


def test_index_deals_out_texts_not_postings(spark, tmp_path, monkeypatch):
    from pagegrain.operators import postings

    plans, stored = [], postings._stored
    monkeypatch.setattr(postings, "_stored", lambda s, df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(s, df, *a, **k))
    rows = [(1, "Ab ab c", "t"), (1, "ab", None), (2, None, "ab"), (3, "x ab", "")]
    index = postings.build(spark, spark.createDataFrame(rows, "k bigint, b string, t string"), "k", "b", "t", str(tmp_path / "index"))
    got = sorted((r.word, r.entry, r.field, r.n, r.first, r.opens) for r in index.postings(spark).where("word = 'ab'").collect())
    assert got == [("ab", 1, "body", 3, 0, True), ("ab", 2, "title", 1, 0, True), ("ab", 3, "body", 1, 1, False)]
    assert [(r.end, r.df, r.n, r.times) for r in index.words(spark).where("word = 'ab'").collect()] == [("ab", 3, 5, 1)]
    assert plans[0].count("Exchange") == 1 and "hashpartitioning(entry" in plans[0]


def test_leaks_are_looked_for_only_where_a_part_of_them_is(spark):
    from pagegrain.operators import markdown

    said = ["cookie", "Cookies", "consentimiento", "Consent", "aceptar todas", "accept all", "newsletter", "boletín", "BOLETIN", "suscríbete", "suscribete", "subscribe to", "sign in", "log in", "iniciar sesión",
        "acceder", "register", "regístrate", "REGISTRATE", "advertisement", "publicidad", "sponsored", "patrocinado", "share this", "comparte", "compartir", "copy link", "comparte este artículo", "related post", "related posts",
        "artículos relacionados", "te puede interesar", "read more", "leer más", "leer mas", "comment", "comments", "comentarios", "all rights reserved", "todos los derechos reservados", "privacy policy", "política de privacidad",
        "terms of use", "terms of service", "follow us", "síguenos", "siguenos", "twitter", "facebook", "instagram", "linkedin", "youtube", "telegram", "whatsapp", "skip to content", "skip to main content", "navigation",
        "menú principal", "menu principal", "main menu", "breadcrumb", "download our app", "download the app", "descarga nuestra app", "descarga la app", "enable javascript", "activa javascript", "subscribe now",
        "suscríbete ahora", "already a subscriber", "ya eres suscriptor", "paywall", "premium", "nothing", "", None]
    forms = (lambda x: x, str.upper, lambda x: x.replace("i", "İ"), lambda x: x.replace("i", "ı"), lambda x: x.replace("s", "ſ"), lambda x: x.replace("k", "K"))
    rows = spark.createDataFrame([(t if t is None else f"a {f(t)} b {t}",) for t in said for f in forms], "t string")
    plain = F.array(*[F.struct(F.lit(k).alias("key"), F.regexp_count("t", F.lit("(?U)" + p)).cast("int").alias("value")) for k, p in markdown.LEAKS.items()])
    both = rows.select("t", markdown.leaks(F.col("t")).alias("got"), F.map_from_entries(F.filter(plain, lambda e: e.value > 0)).alias("want")).collect()
    assert [(r.t, r.got) for r in both] == [(r.t, r.want) for r in both]
    assert {k for r in both for k in r.got or ()} == set(markdown.LEAKS) == set(markdown.LEAK_PARTS)


def test_code_patterns_run_only_where_a_part_of_them_is(spark):
    from pagegrain.functions import code

    more = ["func (a *B) C() {}", "type A struct {", "if err != nil {", "b := []int{1}\nm := map[string]int{}\ngo func() {}", "class A(B):\n  for x in y:\n    pass\n", "import a.b as c\n", "import x from 'y'", "async function f() {}\nx => 1", "as const",
        "insert into t", "Create Table t", "UPDATE t SET", "delete FROM t", "Inner  Join x", "impl<T> A", "&mut x", "@Override", "private int f(int a) throws E {", "var a = new B", "public static class A", "internal record R", "sudo x", "go run x", "function f(a): string {", "const a: B", "pip3 x"]
    texts = spark.createDataFrame([(x,) for x in [*code.SAMPLES, *more]], "t string")
    for k, signals in code.SIGNALS.items():
        for (_, p), parts in zip(signals, code.PARTS[k], strict=True):
            held = [r.t for r in texts.where(F.col("t").rlike("(?d)" + p)).collect()]
            assert all(any(x in (t.lower() if k == "sql" else t) for x in parts) for t in held), (k, p)
    plan = texts.select(code.guessed_language(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 2  # once, and in the name: a text is trimmed once, not for each pattern
