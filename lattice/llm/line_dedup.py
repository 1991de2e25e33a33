"""Line dedup by winnowing over line hashes; DataFrame functions only.

A document is the sequence of its non-blank lines' hashes (ends trimmed). From each line on, a window takes
lines until it holds MIN_WORDS words or MIN_LINES lines; up from each line, another takes lines likewise. Of each
window the smallest line hash (the first on ties) is selected; only selected lines go on, as fingerprints, each
with the extensions up and down that make up the windows it was selected in. A window depends on its own lines
only, so the windows of a run that stands twice select the same lines in both places: a run that is long enough
can't be missed. Fingerprints that occur in one place only are dropped. Those left are joined by position: each
extension is compared with the first place (by document, then line) where the same lines stand around the same
fingerprint, wherever that is, so no place's continuation hides another's. The windows of a run, down from its
lines and up from them, overlap and reach from its first line to its last: together the extensions follow a
match both ways to the mismatch, and all that stand later are deleted.

Lines are compared by two independent 64-bit hashes each: among 1e13 lines the odds of one false match are
about 1e-12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LINES, MIN_WORDS = 4, 40


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each selected line: _id, _th, k (the line), fp, and ws: [first line, lines, hash, hash] of each window that selected it, end to end."""
    solid = F.filter(F.transform(_lines(F.col("text")), _trim), lambda x: x != "")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + F.lit(1)
    rows = docs.select(*common.row_key(), solid.alias("_x"))
    hashed = lambda seed: F.transform("_x", lambda x: F.xxhash64(x, F.lit(seed)))
    rows = rows.select("_id", "_th", hashed(0).alias("_h0"), hashed(1).alias("_h1"), F.transform("_x", words).alias("_w"), F.size("_x").alias("_n"))
    # Arrays stay as they are; what a line needs of its neighbours is read from them by place.
    rows = rows.selectExpr("*", "explode(CASE WHEN _n > 0 THEN sequence(0, _n - 1) END) AS k")
    reach = min_lines - 1
    name = lambda c, j: f"{c}{j + reach}"
    near = range(-reach, reach + 1)
    rows = rows.selectExpr("*", *[f"get(_h0, k + {j}) AS {name('h', j)}" for j in near], *[f"coalesce(get(_w, k + {j}), 0) AS {name('w', j)}" for j in near])
    # t: words of the neighbours before the j-th.
    rows = rows.selectExpr("*", *[f"{' + '.join(['0', *[name('w', i) for i in range(-reach, j)]])} AS {name('t', j)}" for j in range(-reach, reach + 2)])
    held = lambda a, b: f"{name('t', b)} - {name('t', a)} >= {min_words}"
    first = lambda tests, last: "CASE " + " ".join(f"WHEN {t} THEN {j}" for j, t in enumerate(tests, 1)) + f" ELSE {last} END"
    # How many lines up and down have no smaller hash (up: nor the same).
    left = first([f"NOT coalesce({name('h', 0)} < {name('h', -j)}, false)" for j in range(1, reach + 1)], min_lines) + " - 1"
    right = first([f"NOT coalesce({name('h', 0)} <= {name('h', j)}, false)" for j in range(1, reach + 1)], min_lines) + " - 1"
    down = [first([held(o, o + j) for j in range(1, min_lines)], min_lines) + f" AS {name('d', o)}" for o in range(-reach, 1)]
    up = [first([held(e + 1 - j, e + 1) for j in range(1, min_lines)], min_lines) + f" AS {name('u', e)}" for e in range(min_lines)]
    rows = rows.selectExpr("_id", "_th", "k", "_n", "_h0", "_h1", f"{name('h', 0)} AS fp", *[name("t", j) for j in range(-reach, reach + 2)], f"{left} AS _left", f"{right} AS _right", *down, *up)
    windows: list[tuple[str, str, str]] = []  # whether this line was selected in one; its first line from here; its lines
    for o in range(-reach, 1):
        s = name("d", o)
        windows.append((f"k + {o} >= 0 AND k + {o} + {s} <= _n AND {s} + {o} >= 1 AND _left >= {-o} AND _right >= {s} + {o - 1}", f"{o}", s))
    for e in range(min_lines):
        t = name("u", e)
        # A window up from a line is one down from its first line too unless less than all its lines, from there, hold enough.
        other = " OR ".join([f"{t} = {j} AND {held(e + 1 - j, e)}" for j in range(max(2, e + 1), min_lines + 1)])
        windows.append((f"k + {e} < _n AND k + {e + 1} - {t} >= 0 AND {t} >= {e + 1} AND ({other}) AND _left >= {t} - {e + 1} AND _right >= {e}", f"{e + 1} - {t}", t))
    rows = rows.selectExpr("_id", "_th", "k", "fp", "_h0", "_h1", *[f"{c} AS v{i}" for i, (c, _, _) in enumerate(windows)], *[f"k + {o} AS a{i}" for i, (_, o, _) in enumerate(windows)], *[f"{n} AS s{i}" for i, (_, _, n) in enumerate(windows)])
    # Not a filter, which would be moved down through all of the above and work it out twice.
    found = [f"CASE WHEN v{i} THEN array(bigint(a{i}), bigint(s{i}), xxhash64(slice(_h0, a{i} + 1, s{i})), xxhash64(slice(_h1, a{i} + 1, s{i}))) ELSE cast(array() AS array<bigint>) END" for i in range(len(windows))]
    return rows.selectExpr("_id", "_th", "k", "fp", f"explode(CASE WHEN {' OR '.join(f'v{i}' for i in range(len(windows)))} THEN array(concat({', '.join(found)})) END) AS ws")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _th and runs: [a, b) over the document's non-blank lines, each with an earlier equal."""
    selected = common.materialise(fingerprints(docs, min_lines, min_words))  # the one scan that looks at lines
    place = F.xxhash64("_id", "_th", "k")
    # Grouped by another key than the joins', so that these deal both sides anew and can split a hot key.
    often = selected.groupBy(F.bitwise_not("fp").alias("g")).agg(F.min(place).alias("a"), F.max(place).alias("b")).where(F.col("a") != F.col("b")).select(F.bitwise_not("g").alias("fp"))
    some = selected.join(often, "fp", "left_semi")
    some = some.select("_id", "_th", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.lit(4), F.lit(4))).alias("i"))
    some = some.select("_id", "_th", *[F.get("ws", F.col("i") + F.lit(j)).alias(c) for j, c in enumerate(("a", "s", "p", "q"))])
    at = F.struct("_id", "_th", "a")
    first = some.groupBy(F.bitwise_not("p").alias("g"), "q").agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.bitwise_not("g").alias("p"), "q", "_first")
    met = some.join(first, ["p", "q"]).where(at > F.col("_first"))
    run = F.struct(F.col("a").cast("int").alias("a"), (F.col("a") + F.col("s")).cast("int").alias("b"))
    return met.select("_id", "_th", run.alias("run")).groupBy("_id", "_th").agg(F.collect_set("run").alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs of lines deleted from text, and n_lines, n_removed (long).

    A run goes when its lines hold min_lines lines, or min_words words, that stand in the same order earlier:
    in a document of smaller id (then smaller text hash) or further up in the same one. Null texts stay null;
    empty texts and blank lines are never removed and never match. Rows equal in id and text are treated
    alike: none counts as later than the other. Null ids order first. A very long text is one row like any
    other; its lines are dealt with one by one. An empty table gives an empty result. Other columns are kept. A
    column of docs with the name of an added one is replaced.
    """
    if min_lines < 2:
        raise ValueError("min_lines must be 2 or more")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    runs = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words).hint("shuffle_hash")
    keyed = kept.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *common.row_key())
    joined = keyed.join(runs, ["_id", "_th"], "left")
    # Blank lines keep their places: runs count the others.
    lines = joined.select("_row", "runs", _lines(F.col("_row.text")).alias("_lines"))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(_trim(x) != "", i)), lambda i: i.isNotNull())
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.slice(places, r["a"] + F.lit(1), r["b"] - r["a"]))))
    lines = lines.withColumn("_gone", F.when(F.col("runs").isNotNull(), gone))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - F.lit(1)), F.col("_gone")), lambda i: F.get("_lines", i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(left, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]
    n_lines = F.when(F.coalesce(F.col("_row.text"), F.lit("")) == "", 0).otherwise(F.size("_lines"))
    return lines.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
