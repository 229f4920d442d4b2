from pyspark.sql import functions as F

from cloakframe.functions.patterns import Rule
from cloakframe.operators import extract

PYTHON = '''"""Module note."""
import os, sys as system
from typing import List as L

LIMIT: int = 10
a, b = 1, 2

@wraps
class Order(Base):
    """Doc of Order."""
    total = 0

    def __init__(self, customer, *args, qty: int = 3, **kw):
        # customer stays
        self.customer = customer  # and here customer
        self.left, right = 1, "customer"

    async def price(self,
                    rate, tax=os.getenv("tax")):
        amount = rate * self.total
        amount += tax
        for item in self.items:
            print(item, f"{amount}")
        return amount

def main_flow(order):
    if order == LIMIT:
        x = y = order.price(rate=x)
    _ = 3
'''

CPP = """#include <vector>
#define MAX_SIZE 10
namespace shop {
class Basket : public Base {
  int count_;
public:
  void add(int item, std::string label) { count_ += item; } // add item
};
struct Point { double px; };
enum class Color { RED };
using Alias = int;
}
double Basket::sum(const Basket& other) { double result = 0; return result; }
int main() { std::vector<int> values; auto add = "count_"; }
"""


def _symbols(df):
    return {(r.name, r.kind, r.scope) for r in df.collect()}


def test_python_symbols_with_kind_and_scope(texts):
    got = _symbols(extract.symbols(texts(PYTHON), "python"))
    assert got == {
        ("LIMIT", "field", ""),
        ("a", "variable", ""),
        ("b", "variable", ""),
        ("Order", "class", ""),
        ("total", "variable", "Order"),
        ("customer", "parameter", "Order::__init__"),
        ("args", "parameter", "Order::__init__"),
        ("qty", "parameter", "Order::__init__"),
        ("kw", "parameter", "Order::__init__"),
        ("right", "variable", "Order::__init__"),
        ("price", "method", "Order"),
        ("rate", "parameter", "Order::price"),
        ("tax", "parameter", "Order::price"),
        ("amount", "variable", "Order::price"),
        ("item", "variable", "Order::price"),
        ("main_flow", "function", ""),
        ("order", "parameter", "main_flow"),
        ("x", "variable", "main_flow"),
        ("y", "variable", "main_flow"),
    }


def test_python_occurrences_skip_strings_comments_imports_and_decorators(texts):
    lines = {r.line for r in extract.occurrences(texts(PYTHON), "python").where("name = 'customer'").collect()}
    assert lines == {13, 15}
    names = {r.name for r in extract.occurrences(texts(PYTHON), "python").collect()}
    assert not names & {"system", "wraps", "L", "Doc", "Module"}


def test_imported_names_and_modules(texts):
    code = "import os, numpy.linalg as la\nfrom a.b import c as d, e\nfrom x import (f, g)  # note\nx = 1\n"
    row = texts(code).select(extract.imported_names(F.col("text")).alias("n")).head()
    assert set(row.n) == {"os", "la", "numpy", "d", "e", "a", "f", "g", "x"}


def test_imported_names_are_not_symbols(texts):
    got = {r.name for r in extract.symbols(texts("import os\nos = 3\nmine = 4\n"), "python").collect()}
    assert got == {"mine"}


def test_cpp_symbols(texts):
    got = {(r.name, r.kind) for r in extract.symbols(texts(CPP), "cpp").collect()}
    assert {
        ("MAX_SIZE", "macro"),
        ("shop", "namespace"),
        ("Basket", "class"),
        ("Point", "struct"),
        ("Color", "enum"),
        ("Alias", "type_alias"),
        ("sum", "method"),
        ("item", "parameter"),
        ("px", "field"),
        ("count_", "field"),
        ("RED", "enum_constant"),
        ("result", "variable"),
        ("values", "variable"),
    } <= got
    assert not {n for n, _ in got} & {"main", "int", "std", "vector", "string"}
    assert ("sum", "method", "Basket") in _symbols(extract.symbols(texts(CPP), "cpp"))


SCOPED = r"""
#include <map>
#define LIMIT 5
namespace app::core {
enum Mode { FAST, SLOW = 2, OTHER };
enum class Color : int { RED };
class Box final : public Base<int> {
 public:
  Box(int size) : size_(size), n{0} { total = size; }
  ~Box();
  virtual void run(const std::map<int, std::string>& table, int* out = nullptr) const override;
  int size_, *next, grid[3] = {1, 2};
  static const unsigned long long counter;
 private:
  struct Inner { float depth; } inner;
};
template <typename T> T biggest(std::vector<T> items, T seed) {
  for (int i = 0; i < 3; ++i) { auto v = items[i]; if (int z = f(v)) { g(z); } }
  for (const auto& item : items) seed += item;
  std::map<int, Box> lookup, other;
  unsigned x = 5, y(6);
  auto fn = [&](int q) { double inside = 2.0; return inside; };
  return seed;
}
}
void app::core::Box::run(const std::map<int, std::string>& table, int* out) const { int local{3}; table_use(local); }
typedef struct { int a_field; } Record;
typedef void (*Callback)(int);
using Alias = std::vector<int>;
struct Forward;
int global_value = 3;
int main(int argc, char** argv) { try { global_value = 4; } catch (const Err& problem) { } }
"""


def test_cpp_scopes(texts):
    got = {}
    for r in texts(SCOPED).select(F.explode(extract.declared_symbols(F.col("text"), "cpp")).alias("s")).select("s.*").collect():
        got.setdefault((r.kind, r.scope), set()).add(r.name)
    box, big, run = "app::core::Box", "app::core::biggest", "app::core::Box::run"
    assert got == {
        ("macro", ""): {"LIMIT"},
        ("namespace", ""): {"app", "core"},
        ("enum", "app::core"): {"Mode", "Color"},
        ("enum_constant", "app::core::Mode"): {"FAST", "SLOW", "OTHER"},
        ("enum_constant", "app::core::Color"): {"RED"},
        ("class", "app::core"): {"Box"},
        ("struct", box): {"Inner"},
        ("method", box): {"run"},
        ("parameter", f"{box}::Box"): {"size"},
        ("parameter", run): {"table", "out"},
        ("field", box): {"size_", "next", "grid", "counter", "inner"},
        ("field", f"{box}::Inner"): {"depth"},
        ("function", "app::core"): {"biggest"},
        ("parameter", big): {"items", "seed"},
        ("variable", big): {"i", "v", "z", "item", "lookup", "other", "x", "y", "fn", "inside"},
        ("variable", run): {"local"},
        ("field", ""): {"a_field"},
        ("typedef", ""): {"Record", "Callback"},
        ("type_alias", ""): {"Alias"},
        ("struct", ""): {"Forward"},
        ("variable", ""): {"global_value"},
        ("variable", "main"): {"problem"},
    }


def test_cpp_of_any_shape_ends(texts):
    """Deep nesting, text without statements, open brackets, many functions: each within seconds."""
    deep = "{" * 3000 + "int zz;" + "}" * 3000
    rows = [deep, "word " * 100_000, "for ( x " * 10_000, "}}}} int a; {", "", None]
    rows.append("".join(f"void f_{i}(int a_{i}) {{\n  if (a_{i}) {{ int b_{i} = 1; }}\n}}\n" for i in range(3000)))
    got = [r.n for r in texts(*rows).select("doc_id", F.size(extract.declared_symbols(F.col("text"), "cpp")).alias("n")).orderBy("doc_id").collect()]
    assert got[:5] == [1, 0, 0, 1, 0] and got[6] == 9000


def test_comment_spans_hold_the_comment(texts):
    for language, code in (("python", PYTHON), ("cpp", CPP), ("html", "a<!-- x\ny -->b<!---->")):
        rows = extract.comment_spans(texts(code), language).collect()
        assert rows
        for r in rows:
            assert code[r.offset : r.end_offset] == r.comment
            assert code[: r.offset].count("\n") + 1 == r.line
    comments = {r.comment for r in extract.comment_spans(texts(PYTHON), "python").collect()}
    assert {'"""Module note."""', '"""Doc of Order."""', "# customer stays", "# and here customer"} == comments


def test_first_rule_wins_and_users_can_add_rules(texts):
    rules = [Rule("ticket", "constant", "T-[0-9]+"), Rule("any", "string", "[A-Z]-[0-9]+")]
    rows = extract.symbols_by_rule(texts("T-1 and B-2, T-1"), rules).collect()
    assert {(r.name, r.kind, r.scope, tuple(r["at"])) for r in rows} == {
        ("T-1", "constant", "ticket", (0, 2)),
        ("B-2", "string", "any", (1,)),
    }


def test_first_declaration_wins(spark):
    rows = spark.createDataFrame(
        [(1, "n", "class", "", 5), (1, "n", "function", "s", 2), (2, "n", "macro", "", 1)],
        "doc_id long, name string, kind string, scope string, pos long",
    )
    got = {(r.doc_id, r.kind, r.scope) for r in extract.first_symbols(rows, "doc_id", "pos").collect()}
    assert got == {(1, "function", "s"), (2, "macro", "")}


def test_addresses_in_long_runs(texts):
    run = "x" * 300_000
    rows = extract.symbols_by_rule(texts(f"{run} a@b.c_d@e.f {run}@g.hh 1.2.3.4x@y.zz", "a@" + "b." * 20_000 + "c")).collect()
    got = {r.name for r in rows if r.scope == "email"}
    assert got == {"a@b.c", "_d@e.f", f"{run}@g.hh", "1.2.3.4x@y.zz", "a@" + "b." * 20_000 + "c"}


def test_assignments_of_many_names_are_linear(texts):
    """A line costs its length: 10,000 names with and without an equals sign, and near misses."""
    import time

    many = [f"name_{i}" for i in range(10_000)]
    rows = [
        ", ".join(many) + " = 1",
        ", ".join(many),
        ",  ".join(many) + " == 1",
        " " * 50_000 + "x",
        "a = b == c",
        "a, (b.x, c) = d = [1, 2]",
        "first, *rest = items",
        "e, = one",
    ]
    started = time.time()
    found = {
        r["doc_id"]: {s["name"] for s in r["s"]}
        for r in texts(*rows).select("doc_id", extract.declared_symbols(F.col("text"), "python").alias("s")).collect()
    }
    assert time.time() - started < 20
    assert found[1] == set(many) and found[2] == found[3] == found[4] == set()
    assert found[5] == {"a"} and found[6] == {"a", "c", "d"} and found[7] == {"first", "rest"} and found[8] == {"e"}
