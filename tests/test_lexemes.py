"""Blocks of typed and unusual brace-language code, from tables of lexemes."""

from __future__ import annotations

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from cinderlake.operators import blocks, lexemes, packing

TS = r'''import { a } from "x";
export default class Store<T extends { id: number }> extends Base<T> implements Reader {
  private items: Map<string, T[]> = new Map();
  count = 1
  constructor(private readonly x: number, y = () => ({ z: 1 })) {
    super();
  }
  private async go(a: number, f: (b: string) => void = () => {}): Promise<T> {
    if (a) { return `}${a ? `{${"}"}` : '{'}` as any; }
    for (const x of [1]) { while (x) { } }
    return await this.items.get("a")!;
  }
  m(): RegExp {
    const r = /[{"]/.test("x") ? 1 / 2 : 3 / 4;
    return /\/{/g;
  }
  static *[Symbol.iterator]<U>(u: U) {
    yield u;
  }
  get size(): { a: number; b: { c: T } } { return 1; }
}
interface NoClass { f(): void }
export async function load<T>(
  url: string,
  more?: { a: number },
): Promise<T | null> {
  return null;
}
export const add = async (x: number): Promise<number> => {
  const inner = y => { return y; };
  return list.map(function named(z) { return z; });
};
const short = (q: string) => q + "{" +
  q;
var table = { run(k) { return k; }, "key"(k) { return 1; }, b: function () { return 2; } };
describe("all", () => {
  function nested() {
    return 1;
  }
});
const view = (
  props: Props
) => {
  return <div className="a">{props.x}</div>;
};
'''

JAVA = '''package a.b;
import java.util.*;
@Service("x")
public final class Game<T extends Comparable<T>> extends Base implements Runnable {
  private static final String TEXT = """
    class No { "quoted" }
    """;
  private char c = '{';
  @Override
  public Map<String, List<T>> find(@Named("a") String x, int... more) throws IOException, Bad {
    if (x == null) { return null; } else if (more.length > 0) { throw new Bad(); }
    synchronized (this) { run(); }
    try (Reader r = open()) { } catch (Exception e) { } finally { }
    Runnable later = new Runnable() {
      public void run() { }
    };
    return list.stream().map(y -> { return y; }).toList();
  }
  Game(int x) { this.x = x; }
  abstract int[] sizes();
  interface Inner { void call(String a); }
  record Point(int x, int y) implements Runnable { public void run() { go(); } }
}
'''


def found(spark, path, code):
    rows = blocks.extract_blocks(spark.createDataFrame([(path, code)], "filepath string, code string")).orderBy("pos").collect()
    for r in rows:
        assert r["code"] == "\n".join(code.splitlines()[r["start_line"] - 1 : r["end_line"]])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [(r["symbol_type"], r["name"], r["start_line"], r["end_line"]) for r in rows]


def test_typed_script(spark):
    assert found(spark, "src/store.ts", TS) == [
        ("Class", "Store", 2, 21), ("Function", "constructor", 5, 7), ("Function", "go", 8, 12), ("Function", "m", 13, 16), ("Function", "[ Symbol . iterator ]", 17, 19), ("Function", "size", 20, 20),
        ("Function", "load", 23, 28), ("Function", "add", 29, 32), ("Function", "inner", 30, 30), ("Function", "short", 33, 34), ("Function", "run", 35, 35), ("Function", '""', 35, 35),
        ("Function", "nested", 37, 39), ("Function", "view", 41, 45),
    ]


def test_java(spark):
    assert found(spark, "Game.java", JAVA) == [
        ("Class", "Game", 3, 23), ("Function", "find", 9, 18), ("Function", "run", 15, 15), ("Function", "Game", 19, 19), ("Function", "sizes", 20, 20),
        ("Class", "Inner", 21, 21), ("Function", "call", 21, 21), ("Class", "Point", 22, 22), ("Function", "run", 22, 22),
    ]


def test_verdicts_on_common_code(spark):
    assert found(spark, "a.ts", "class A {\n  private async go(a: number): Promise<T> {\n    return 1;\n  }\n}\n") == [("Class", "A", 1, 5), ("Function", "go", 2, 4)]
    assert found(spark, "b.js", 'class A {\n  m() {\n    const r = /[{"]/;\n    return r;\n  }\n  n() {\n  }\n}\n') == [("Class", "A", 1, 8), ("Function", "m", 2, 5), ("Function", "n", 6, 7)]


def test_broken_and_long_code(spark):
    assert found(spark, "a.js", "}\n}\nfunction f() {\n  return 1;\n}\n}\nfunction g() {\n") == [("Function", "f", 3, 5), ("Function", "g", 7, 7)]
    assert found(spark, "b.js", "const s = `" + "x{" * 30_000 + "`;\nfunction f() {\n  // }\n}\n") == [("Function", "f", 2, 4)]
    assert found(spark, "c.js", "/*" + "{" * 100_000 + "*/ function f() { return \"" + "\\\\" * 20_000 + "\"; }") == [("Function", "f", 1, 1)]
    assert found(spark, "d.js", "function f() {" + "if (x) { y(); }\n" * 5_000 + "}") == [("Function", "f", 1, 5001)]
    assert found(spark, "e.ts", "   \n\n") == [] and found(spark, "f.java", "{;}") == []


def test_lexemes_add_up_to_the_code(spark):
    code = TS + JAVA + "/* open `"
    parts = spark.range(1).select(F.regexp_extract_all(F.lit(code), F.lit(lexemes.LEXEME), F.lit(0)).alias("x")).first()["x"]
    assert "".join(parts) == code


@pytest.mark.parametrize("n", [1, 3])
def test_copies_of_a_file_have_their_own_blocks(spark, n):
    files = spark.createDataFrame([("a.js", "function f() {\n}\n")] * n + [("b.ts", None), ("c.java", ""), (None, "class A {}")], "filepath string, code string")
    got = blocks.extract_blocks(files).collect()
    assert [(r["name"], r["pos"], r["end_line"]) for r in got] == [("f", 0, 2)] * n


def test_partitions_of_lexemes_grow_with_the_code(spark, monkeypatch):
    files = spark.createDataFrame([(f"f{k}.ts", TS) for k in range(12)], "filepath string, code string").withColumn("file_no", F.monotonically_increasing_id())
    assert lexemes.lexeme_parts(files) is None  # the session's number will do
    found = lambda: sorted(map(tuple, lexemes.extract_lexeme_blocks(files).collect()))
    want = found()
    monkeypatch.setattr(lexemes, "PART_CHARS", len(TS))
    parts = lexemes.lexeme_parts(files)
    assert parts == 12 and lexemes.lexeme_table(files, parts).rdd.getNumPartitions() == 12
    assert found() == want


def test_files_of_one_partition_are_dealt_out(spark, monkeypatch):
    """A small table can be the code of many files; neither parsers, lexemes nor packs are to run in its one task."""
    code = F.concat(F.lit("class A"), F.col("id"), F.lit(" {\n  m() {\n    return 1;\n  }\n}\n"))
    files = spark.range(0, 400, 1, 1).select(F.concat("id", F.when(F.col("id") % 2 == 0, ".py").otherwise(".js")).alias("filepath"), code.alias("code"))
    written, kept = [], lexemes.materialize
    monkeypatch.setattr(lexemes, "materialize", lambda df, name: written.append(df) or kept(df, name))
    found = blocks.extract_blocks(files, extractors={".py": lambda _: [("Function", str(TaskContext.get().partitionId()), 1, 1)]})
    tasks = {r["name"] for r in found.filter("filepath like '%.py'").select("name").collect()}
    assert len(tasks) > 1 and found.count() == 600
    sizes = written[0].groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 200
    packs = packing.pack_chunks(found)
    assert packs.count() == 400
    assert any("pack" in line and "REPARTITION_BY_NUM" in line for line in packs._jdf.queryExecution().executedPlan().toString().splitlines())


def test_tables_that_grow_with_the_files_are_not_broadcast(spark, monkeypatch):
    """Compressed files tell little of their rows' size in memory: a join of files, blocks or packs is none that the driver holds one side of."""
    code = F.concat(F.lit("class A"), F.col("id"), F.lit(" {\n  m() {\n    return 1;\n  }\n}\n"))
    files = spark.range(0, 40, 1, 1).select(F.concat("id", F.when(F.col("id") % 2 == 0, ".ts").otherwise(".js")).alias("filepath"), code.alias("code"))
    written, kept = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: written.append(df) or kept(df, name))
    found = blocks.extract_blocks(files)
    packs = packing.pack_chunks(found)
    assert sorted(r["token_count"] for r in packs.collect()) == [9] * 40
    plans = [line for df in (found, *written, packs) for line in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    sent = [line for line in plans if "BroadcastHashJoin" in line and "part#" not in line]  # folds send a few rows a partition
    assert not sent and any("SortMergeJoin [file_no#" in line for line in plans)
