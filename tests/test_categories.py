from shelfspark.operators import categories


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_references(spark):
    page = """<a href="/list?id_category=1&id_subcategory=2&x=3">Frenos</a><a href="/about">About</a><li data-id-category="4" data-subcategory="5">Luces</li>
      <select name="id_subsubcategory"><option value="7">Siete</option><option value="x">no</option></select><select name="id_subcategory"><option value="8">Ocho</option></select>
      <select name="categories"><option value="9">Nueve</option></select><a href="/v2/productos/motor/filtros%20de%20aire/33/kit"></a>
      <script>load("load-data-search.php?id_category=1&option_filter=6")</script><a href="/list?id_category=1&id_subcategory=2">Frenos y discos</a>"""
    df = spark.createDataFrame([("https://p.example/a", page), ("https://p.example/b", None)], "url string, html string")
    got = rows(categories.category_refs(df), "key", "name", "level", "parent_key")
    assert got == sorted(
        [
            ("cat:1|sub:2|subsub:|opt:", "Frenos y discos", "subcategory", "cat:1|sub:|subsub:|opt:"),
            ("cat:4|sub:5|subsub:|opt:", "Luces", "subcategory", "cat:4|sub:|subsub:|opt:"),
            ("cat:|sub:|subsub:7|opt:", "Siete", "subsubcategory", None),
            ("cat:|sub:8|subsub:|opt:", "Ocho", "subcategory", None),
            ("cat:9|sub:|subsub:|opt:", "Nueve", "category", None),
            ("cat:|sub:|subsub:33|opt:", "filtros de aire", "subsubcategory", None),
            ("cat:1|sub:|subsub:|opt:6", None, "category", "cat:1|sub:|subsub:|opt:"),
        ],
        key=repr,
    )


def test_tree(spark):
    chain = [(f"k{i}", f"k{i - 1}" if i else None, f"L{i}") for i in range(40)]
    others = [("a", "b", "A"), ("b", "a", "B"), ("c", "a", "C"), ("self", "self", "S"), ("orphan", "gone", "O"), ("leaf", "orphan", "P")]
    got = {r.key: (r.depth, r.root, r.path) for r in categories.tree(spark.createDataFrame(chain + others, "key string, parent string, label string")).collect()}
    want = {f"k{i}": (i, "k0", [f"L{j}" for j in range(i + 1)]) for i in range(40)} | {"orphan": (0, "orphan", ["O"]), "leaf": (1, "orphan", ["O", "P"])}
    assert got == want | dict.fromkeys(("a", "b", "c", "self"), (None, None, None))
    assert categories.tree(spark.createDataFrame([], "key string, parent string, label string")).collect() == []


def test_tree_of_references(spark):
    page = '<a href="?id_category=1">Motor</a><a href="?id_category=1&id_subcategory=2">Filtros</a><a href="?id_category=1&id_subcategory=2&id_subsubcategory=3">Aire</a>'
    refs = categories.category_refs(spark.createDataFrame([("https://p.example/a", page)], "url string, html string"))
    got = categories.tree(refs.selectExpr("key", "parent_key parent", "name label"))
    assert rows(got, "depth", "path") == [(0, ["Motor"]), (1, ["Motor", "Filtros"]), (2, ["Motor", "Filtros", "Aire"])]
