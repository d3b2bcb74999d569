"""Points-to sets across procedures, with call-site contexts of bounded length, as semi-naive joins.

Tables of a program:

entries (method); allocs (method, var, obj, type); copies (method, src, dst); loads (method, base, field, dst);
stores (method, base, field, src); calls (method, site, receiver, name, target, result): ``target`` is known for static
calls, others have a receiver and a name; actuals (site, pos, var) and formals (method, pos, var), ``this`` at pos -1;
returns (method, var); dispatch (type, name, target), see ``dispatch_table``.

An object is an allocation site; a field of an object is a node of its own. Only methods that some entry reaches count.
A context is the last ``k`` call sites; with ``k`` 0 there is one. What a receiver may be decides what is called, and
each target's ``this`` holds only the objects that lead to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

NODE = ["field_of", "method", "ctx", "var"]
FACT = [*NODE, "obj"]
#: Methods of containers that put an argument into them, and its position.
CONTAINER_WRITES = (("Set", "add", 0), ("Map", "set", 1), ("Array", "push", 0))
ELEMENT = "[]"
#: Names of this analysis' own: the variable and object of application storage, and how function values are called.
STORAGE, INVOKED = "%storage", "()"


@dataclass
class Program:
    entries: DataFrame
    allocs: DataFrame
    copies: DataFrame
    loads: DataFrame
    stores: DataFrame
    calls: DataFrame
    actuals: DataFrame
    formals: DataFrame
    returns: DataFrame
    dispatch: DataFrame


def dispatch_table(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """type, name, target: what a call of ``name`` on an object of ``type`` runs, the nearest definition up its supers.

    classes: (class, super); methods: (method, class, name).
    """
    up = stored(classes.select(F.col("class").alias("type"), F.col("class").alias("at")).distinct(), "up")
    own, above = stored(methods.select(F.col("class").alias("at"), "name", F.col("method").alias("target")).distinct(), "own"), classes.filter("super IS NOT NULL").select(F.col("class").alias("at"), "super").distinct()
    done = stored(up.join(own, "at").select("type", "name", "target"), "dispatch")
    seen = up
    while True:
        up = stored(up.join(above, "at").select("type", F.col("super").alias("at")).distinct().join(seen, ["type", "at"], "left_anti"), "up")
        if up.limit(1).count() == 0:
            return done
        seen = seen.unionByName(up)
        more = up.join(own, "at").select("type", "name", "target").join(done, ["type", "name"], "left_anti")
        done = stored(done.unionByName(more), "dispatch")


def container_stores(calls: DataFrame, actuals: DataFrame, types: DataFrame, writes: tuple = CONTAINER_WRITES) -> DataFrame:
    """Stores (method, base, field, src) of what calls put into containers; all elements of one are one field.

    types: (method, var, type), declared types of receivers.
    """
    spark = calls.sparkSession
    known = spark.createDataFrame(list(writes), "type string, name string, pos int")
    return calls.join(types.withColumnRenamed("var", "receiver"), ["method", "receiver"]).join(F.broadcast(known), ["type", "name"]).join(actuals, ["site", "pos"]).select("method", F.col("receiver").alias("base"), F.lit(ELEMENT).alias("field"), F.col("var").alias("src"))


def storage_facts(accesses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """allocs, copies, loads, stores of application storage, one object all methods share whose fields are properties.

    accesses: (method, receiver, name, property, value, result) of calls on storage, static ones without receiver;
    ``property`` is the literal named, ``value`` the variable handed in. ``setOrCreate`` writes a property; ``link`` ties
    its result to one in both directions, ``prop`` only reads into it; ``set`` and ``get`` on a tied variable write to it
    and read its property, a static ``get`` reads the property named. Calls without a literal property are passed over.
    """
    named = accesses.filter("receiver IS NULL AND property IS NOT NULL")
    base, tied = F.lit(STORAGE).alias("base"), named.filter("name IN ('link', 'prop') AND result IS NOT NULL")
    on = accesses.filter("receiver IS NOT NULL").select("method", "receiver", "name", "value", "result").join(tied.select("method", F.col("result").alias("receiver"), "property"), ["method", "receiver"])
    writes = named.filter("name = 'setOrCreate' AND value IS NOT NULL").select("method", base, F.col("property").alias("field"), F.col("value").alias("src"))
    stores = writes.unionByName(tied.filter("name = 'link'").select("method", base, F.col("property").alias("field"), F.col("result").alias("src")))
    read = named.filter("name = 'get' AND result IS NOT NULL").unionByName(tied, True).select("method", "property", "result")
    loads = read.unionByName(on.filter("name = 'get' AND result IS NOT NULL").select("method", "property", "result")).select("method", base, F.col("property").alias("field"), F.col("result").alias("dst"))
    copies = on.filter("name = 'set' AND value IS NOT NULL").select("method", F.col("value").alias("src"), F.col("receiver").alias("dst"))
    allocs = accesses.select("method", F.lit(STORAGE).alias("var"), F.lit(STORAGE).alias("obj"), F.lit(STORAGE).alias("type"))
    return tuple(t.distinct() for t in (allocs, copies, loads, stores))


def library_facts(calls: DataFrame, library: DataFrame, handed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """allocs and calls that stand for what library methods do, whose code isn't there.

    library: (target, type), methods and the class each returns, null if none; handed: (site, function variable), as
    (site, var). A method's result is an object of its own, one a method; a function handed in is called.
    """
    into = calls.join(library, "target")
    allocs = into.filter("result IS NOT NULL AND type IS NOT NULL").select("method", F.col("result").alias("var"), F.concat(F.lit("library:"), "target").alias("obj"), "type")
    back = into.join(handed, "site").select("method", F.concat_ws(":", "site", "var").alias("site"), F.col("var").alias("receiver"), F.lit(INVOKED).alias("name"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("result"))
    return allocs.distinct(), back.distinct()


def function_facts(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """allocs and dispatch for references (method, var, function): functions as objects, called by the name ``()``."""
    name = F.concat(F.lit("function:"), "function")
    return references.select("method", "var", name.alias("obj"), name.alias("type")).distinct(), references.select(name.alias("type"), F.lit(INVOKED).alias("name"), F.col("function").alias("target")).distinct()


def _extended(ctx: Column, site: Column, k: int) -> Column:
    return F.slice(F.concat(F.array(site), ctx), 1, k) if k else F.array().cast("array<string>")


def _local(method: str, ctx: str, var: str) -> list[Column]:
    return [F.lit(None).cast("string").alias("field_of"), F.col(method).alias("method"), F.col(ctx).alias("ctx"), F.col(var).alias("var")]


def _of_object(obj: str, field: str) -> list[Column]:
    return [F.col(obj).alias("field_of"), F.lit(None).cast("string").alias("method"), F.array().cast("array<string>").alias("ctx"), F.col(field).alias("var")]


def _ends(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.struct(*a).alias("src"), F.struct(*b).alias("dst")]


def solve(p: Program, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Facts (field_of, method, ctx, var, obj) and calls (method, ctx, site, target, inner), ``inner`` the target's context.

    Methods, variables, fields, objects, types and sites are strings. ``field_of`` names the object whose field ``var``
    is, and is null for a method's variable. Each round joins only what the last one found, with all that is known,
    until nothing is new. Facts are kept flat and joined on plain columns; edges between variables of one method need
    no context and are joined as they stand.
    """
    p = Program(**{name: stored(table.distinct(), name) for name, table in vars(p).items()})  # tables of known size
    allocs = p.allocs.select("method", "var", "obj", "type")
    kind_of = stored(allocs.select("obj", "type").distinct(), "types")
    calls = p.calls.select("method", "site", "receiver", "name", "target", "result")
    fixed, dynamic = calls.filter("target IS NOT NULL"), calls.filter("target IS NULL AND receiver IS NOT NULL")
    this = p.formals.filter("pos = -1").select(F.col("method").alias("target"), F.col("var").alias("this"))
    passed = p.actuals.filter("pos >= 0").select("site", "pos", F.col("var").alias("actual"))
    taken = p.formals.filter("pos >= 0").select(F.col("method").alias("target"), "pos", F.col("var").alias("formal"))
    given = p.returns.select(F.col("method").alias("target"), F.col("var").alias("returned"))

    fresh_in = stored(p.entries.select("method", F.array().cast("array<string>").alias("ctx")).distinct(), "reached")
    reached, facts, fresh, edges, called = fresh_in, None, None, None, None
    for i in count():
        # Calls that are new: static ones of methods reached last, and those that new receivers lead to.
        made = fresh_in.join(fixed, "method").select("method", "ctx", "site", "target", "result")
        bound = None
        if fresh is not None:
            on = fresh.filter("field_of IS NULL").select("method", "ctx", F.col("var").alias("receiver"), "obj")
            led = on.join(dynamic, ["method", "receiver"]).drop("target").join(kind_of, "obj").join(p.dispatch, ["type", "name"])
            led = stored(led.select("method", "ctx", "site", "target", "result", "obj").distinct(), f"led{i}")
            made = made.unionByName(led.drop("obj"))
            bound = led.withColumn("inner", _extended(F.col("ctx"), F.col("site"), k)).join(this, "target").select(*_local("target", "inner", "this"), "obj")
        made = made.withColumn("inner", _extended(F.col("ctx"), F.col("site"), k)).distinct()
        if called is not None:
            made = made.join(called, ["method", "ctx", "site", "target"], "left_anti")
        made = stored(made, f"made{i}")

        # New edges: arguments, results, and the fields of new objects of bases.
        found = made.join(passed, "site").join(taken, ["target", "pos"]).select(*_ends(_local("method", "ctx", "actual"), _local("target", "inner", "formal")))
        found = found.unionByName(made.filter("result IS NOT NULL").join(given, "target").select(*_ends(_local("target", "inner", "returned"), _local("method", "ctx", "result"))))
        if fresh is not None:
            at = fresh.filter("field_of IS NULL").select("method", "ctx", F.col("var").alias("base"), "obj")
            found = found.unionByName(at.join(p.loads, ["method", "base"]).select(*_ends(_of_object("obj", "field"), _local("method", "ctx", "dst"))))
            found = found.unionByName(at.join(p.stores, ["method", "base"]).select(*_ends(_local("method", "ctx", "src"), _of_object("obj", "field"))))
        found = found.select(F.xxhash64("src").alias("h"), "src", "dst").distinct()
        if edges is not None:
            found = found.join(edges, ["h", "src", "dst"], "left_anti")
        added = stored(found, f"edges{i}")

        # New facts: allocations of methods reached last, what flows, what ``this`` is bound to.
        flows = fresh_in.join(allocs, "method").select(*_local("method", "ctx", "var"), "obj")
        if bound is not None:
            flows = flows.unionByName(bound)
        if fresh is not None:
            flows = flows.unionByName(fresh.filter("field_of IS NULL").withColumnRenamed("var", "src").join(p.copies.select("method", "src", F.col("dst").alias("var")), ["method", "src"]).select(*FACT))
            flows = flows.unionByName(_along(fresh, edges)).unionByName(_along(facts, added))
        flows = flows.select(*FACT).distinct()
        new = flows if facts is None else flows.join(facts.select(*[F.col(c).alias(f"k_{c}") for c in FACT]), _all_same(FACT), "left_anti")
        new = stored(new, f"facts{i}")
        inside = stored(made.select(F.col("target").alias("method"), F.col("inner").alias("ctx")).distinct().join(reached, ["method", "ctx"], "left_anti"), f"reached{i}")
        reached = reached.unionByName(inside)
        called = made if called is None else called.unionByName(made)
        edges = added if edges is None else edges.unionByName(added)
        facts = new if facts is None else facts.unionByName(new)
        if all(t.limit(1).count() == 0 for t in (new, inside, added)):
            return facts, called.select("method", "ctx", "site", "target", "inner").distinct()
        fresh, fresh_in = new, inside
        if i % 8 == 7:  # unions of few tables are read, not of one a round
            reached, called, edges, facts = stored(reached, "reached"), stored(called, "called"), stored(edges, "edges"), stored(facts, "facts")


def _all_same(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"k_{n}"))
    return out


def _along(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """What facts become behind edges (h, src, dst)."""
    node = F.struct(*NODE)
    at = facts.select(F.xxhash64(node).alias("h"), node.alias("src"), "obj")
    return at.join(edges, ["h", "src"]).select("dst.*", "obj")


def without_contexts(facts: DataFrame) -> DataFrame:
    """method, var, obj over all contexts, variables only."""
    return facts.filter("field_of IS NULL").select("method", "var", "obj").distinct()


def aliases(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """method, a, b, may_alias: whether two variables of a method can hold one object in one context."""
    held = facts.filter("field_of IS NULL").select("method", "ctx", "var", "obj")
    left = pairs.select("method", "a", "b").distinct().join(held.withColumnRenamed("var", "a"), ["method", "a"])
    both = left.join(held.withColumnRenamed("var", "b"), ["method", "b", "ctx", "obj"]).select("method", "a", "b").distinct()
    return pairs.select("method", "a", "b").distinct().join(both.withColumn("may_alias", F.lit(True)), ["method", "a", "b"], "left").withColumn("may_alias", F.coalesce("may_alias", F.lit(False)))


def type_differences(points: DataFrame, declared: DataFrame, types: DataFrame) -> DataFrame:
    """node, declared, found: nodes whose objects include one of another type than declared; ``found`` sorted, distinct.

    points: (node, obj); declared: (node, declared); types: (obj, type).
    """
    each = points.join(types, "obj").groupBy("node").agg(F.array_sort(F.collect_set("type")).alias("found"))
    return declared.join(each, "node").filter(F.size(F.array_except("found", F.array("declared"))) > 0).select("node", "declared", "found")


def set_statistics(points: DataFrame) -> DataFrame:
    """n_objects, n_nodes: how many nodes (node, obj) hold how many objects."""
    return points.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_objects")).groupBy("n_objects").agg(F.count(F.lit(1)).alias("n_nodes"))
