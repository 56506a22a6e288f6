"""Definitions and calls of JavaScript and Java, in the forms that a search for names alone gets wrong."""

import ast
import time

from loomgraph.extract.code import extract_code, parse_python


def structure(path, text):
    triples, concepts = extract_code(path, text)
    found = {}
    for t in triples:
        found.setdefault(t["relation"], set()).add((t["head"], t["tail"]))
    return found, {c["name"]: (c["node_type"], c["description"]) for c in concepts}


def test_javascript_methods_and_functions():
    found, about = structure("m.js", """
        export default class Crate extends mixin(Base) {
          #seal(a) { return this.#check(a); }
          static async load(p = first()) { for await (const q of (list())) { use(q); } }
          [Symbol.iterator]() { return walk(); }
          handler = () => { fire(); };
        }
        const o = { pack(item) { wrap(item); }, of: 1 };
        function* gen() { step(); }
        const f = function named() { go(); };
        const K = class Inner { m() { k(); } };
        async function top(a) { function nested() { deep(); } }
        if (a) { b(); }""")
    assert found["defines"] == {("m", "Crate"), ("m", "top")}
    assert found["contains"] == {("Crate", n) for n in ("#seal", "load", "[Symbol.iterator]")}
    assert found["calls"] == {
        ("m", "mixin"), ("#seal", "#check"), ("load", "first"), ("load", "list"), ("load", "use"), ("[Symbol.iterator]", "walk"), ("m", "fire"),
        ("pack", "wrap"), ("m", "step"), ("m", "go"), ("m", "k"), ("nested", "deep"), ("m", "b"),
    }
    assert about["pack"] == ("method", "method pack(item)") and about["load"] == ("method", "method Crate.load(p = first())")
    assert about["m"] == ("method", "method m()") and about["nested"] == ("function", "function nested()") and about["Crate"][0] == "class"


def test_javascript_literals_and_calls():
    found, about = structure("src/n.js", r"""
        const re = /["'(`]/g, half = total() / 2 / 3;
        text(`a ${inner(`${most()}`)} }{ b`); tag`x`; p.then(x => x).catch(lost); of(1); maybe?.(2);
        new Thing(arg()); new a.b.Other(); import("z"); (async (x) => run(x))(); // gone()
        "no(1)"; /* nor(2) */""")
    assert {t for _, t in found["calls"]} == {"total", "text", "inner", "most", "tag", "then", "catch", "of", "maybe", "arg", "run"}
    assert about["n"] == ("module", "module n (js)") and about["tag"] == ("function", "function tag")


def test_java_members():
    found, about = structure("p/M.java", """
        @Entity(name = "x") public class A<T> extends B {
          private final List<String> names = List.of("a");
          private Runnable r = new Runnable() { public void run() { tick(); } };
          @Inject public A(int x) { super(x); setup(x); }
          A() { this(1); }
          @Override public <K> Map<K, T> build(final K k, int... v) throws x.Y { go(new D(1).h()); return () -> { late(); }; }
          abstract void k(); native int[] z();
          enum Color { RED(1), GREEN(2) { int w() { return gw(); } }, BLUE; Color(int c) { cc(c); } }
          interface I { void i1(); default int i2() { return j(); } }
          record P(int x) { P { check(x); } double len() { return Math.sqrt(x); } }
          @interface Ann { String value() default "q"; }
        }""")
    assert found["defines"] == {("M", "A")}
    assert found["contains"] == {("A", n) for n in ("run", "build", "k", "z", "w", "i1", "i2", "len")}
    assert found["calls"] == {
        ("M", "of"), ("run", "tick"), ("M", "setup"), ("build", "go"), ("build", "h"), ("build", "late"), ("w", "gw"), ("M", "cc"), ("i2", "j"), ("M", "check"), ("len", "sqrt"),
    }
    assert about["build"] == ("method", "method A.build(final K k, int... v)") and about["M"][1] == "module M (java)"
    alone, about = structure("I.java", "interface J { void f(); }")
    assert alone == {} and about["f"] == ("method", "method f()")


def test_python_decorators_and_kinds():
    found, about = structure("d.py", "@route('/x')\ndef f(a=g()):\n    h()\nclass K:\n    @p.setter\n    @wrap(1)\n    async def m(self): f()\n")
    assert found["calls"] == {("d", "route"), ("f", "g"), ("f", "h"), ("d", "wrap"), ("m", "f")}
    assert found["contains"] == {("K", "m")} and about["m"] == ("method", "method K.m(self)") and about["f"][0] == "function"


def test_broken_text_ends():
    for text in ("", "class", "class A {", "function f(", "f(", "`${", "`", "\"", "/", "}})", "a.", "new", "class A { m() {", "${`", "/*"):
        extract_code("x.js", text)
        extract_code("x.java", text)


def test_python_with_many_broken_lines_takes_linear_time():
    began = time.time()
    tree = parse_python("\n".join(f"def f{i}(x):\n    print 'x{i}'\n    return g{i}(x)\n" for i in range(4000)))
    assert len(tree.body) == 4000 and all(ast.unparse(f.body[1]).startswith("return g") for f in tree.body)
    assert time.time() - began < 20  # all lines anew for each error would take minutes
    kept = ast.unparse(parse_python('class A:\n    """doc\nmore (\nif so:\n    """\n    def m(self):\n        print "x"\n        return g()\n\nx = (1,\n2,\n)\nexec "a"\ndef h():\n    try:\n        pass\n    except E, e:\n        k()\n\ndef z():\n    w()\n'))
    assert all(x in kept for x in ("if so:", "return g()", "x = (1, 2)", "def z():", "w()"))
    assert [n.name for n in parse_python("try:\n    pass\nprint 'x'\ndef q():\n    pass\n").body if isinstance(n, ast.FunctionDef)] == ["q"]
    assert parse_python("y = (1\n").body is not None and parse_python("").body == []


def test_files_of_one_partition_are_dealt_to_tasks(spark):
    from pyspark.sql import functions as F

    from loomgraph.extract.code import code_track

    files = spark.range(40).coalesce(1).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit(".py").alias("suffix"), F.lit("def f():\n    return g()\n").alias("text"))
    rows = code_track(files, ("python",)).select(F.spark_partition_id().alias("p"), "source_file").collect()
    assert len({r["source_file"] for r in rows}) == 40 and len({r["p"] for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
