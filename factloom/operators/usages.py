"""What a reference is there for, from the tree around it; known calls of reflection by a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import fixpoint, sums_to_root, written

#: Nodes that only wrap a type's name, and nodes of documentation.
WRAPPERS = ("QualifiedName", "AliasQualifiedName", "NullableType", "ArrayType")
DOCUMENTATION = (
    "NameMemberCref", "TypeCref", "QualifiedCref", "ConversionOperatorMemberCref", "IndexerMemberCref", "OperatorMemberCref", "XmlCrefAttribute",
    "SingleLineDocumentationCommentTrivia", "MultiLineDocumentationCommentTrivia",
)
#: Fixed values, in order: class, kinds of the parent, and the place in it that the type has, or any.
TYPE_CLASSES = (
    ("GenericArgument", ("TypeArgumentList",), None),
    ("MethodReturnType", ("MethodDeclaration", "LocalFunctionStatement"), "ReturnType"),
    ("MethodParameter", ("Parameter",), "Type"),
    ("PropertyType", ("PropertyDeclaration",), "Type"),
    ("LocalVariable", ("VariableDeclaration",), "Type"),
    ("BaseType", ("SimpleBaseType", "BaseList"), None),
    ("Cast", ("CastExpression",), "Type"),
    ("Cast", ("AsExpression",), "Right"),
    ("TypeCheck", ("IsPatternExpression", "IsExpression", "TypePattern", "DeclarationPattern"), None),
    ("ObjectCreation", ("ObjectCreationExpression",), "Type"),
    ("ObjectCreation", ("ImplicitObjectCreationExpression",), None),
)
#: Namespace, type and method of known calls (null is any), and what each is reported as.
REFLECTION = (
    ("System", "Type", "GetType", "Type.GetType"),
    ("System", "Activator", "CreateInstance", "Activator.CreateInstance"),
    ("System.Reflection", "Assembly", "GetType", "Assembly.GetType"),
    ("System.Reflection", "Assembly", "Load", "Assembly.Load"),
    ("System.Reflection", "Assembly", "LoadFrom", "Assembly.LoadFrom"),
    ("System.Reflection", None, "Invoke", "Reflection.Invoke"),
    ("System.Reflection", "PropertyInfo", "GetValue", "PropertyInfo.GetValue"),
    ("System.Reflection", "PropertyInfo", "SetValue", "PropertyInfo.SetValue"),
    ("System.Reflection", "FieldInfo", "GetValue", "FieldInfo.GetValue"),
    ("System.Reflection", "FieldInfo", "SetValue", "FieldInfo.SetValue"),
    *((None, "Type", m, f"Type.{m}") for m in ("GetMethod", "GetProperty", "GetField", "GetMember", "GetMethods", "GetProperties", "GetFields", "GetMembers")),
)


def _around(at: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes ``at`` with their place, and the kinds, places and modifiers of what is above and two above (beside the columns of ``at``)."""
    own = nodes.select(F.col("node").alias("at"), F.col("slot").alias("slot"), F.col("parent").alias("p"))
    one = nodes.select(F.col("node").alias("p"), F.col("kind").alias("p_kind"), F.col("slot").alias("p_slot"), F.col("modifier").alias("p_modifier"), F.col("parent").alias("g"))
    two = nodes.select(F.col("node").alias("g"), F.col("kind").alias("g_kind"))
    return at.join(own, "at", "left").join(one, "p", "left").join(two, "g", "left").drop("p", "g")


def type_usages(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The class of each reference to a type (ref, classification).

    ``refs``: ref, node, is_static (of the type); ``nodes``: node, parent,
    kind, slot (the place that a node has in its parent), modifier.  Inside
    documentation, however deep, is Documentation; else what is above the
    name, once wrappers of it are left behind, decides; Other if nothing does.
    """
    nodes = written(nodes.select("node", "parent", "kind", "slot", "modifier"), "usages-nodes")
    up = nodes.select(F.col("node").alias("at"), "parent").join(nodes.filter(F.col("kind").isin(*WRAPPERS)).select(F.col("node").alias("parent")), "parent").select("at", "parent")
    climbed = fixpoint(refs.select("ref", F.col("node").alias("at")), lambda front, seen: front.join(up, "at").select("ref", "parent"), "usages-wrappers")
    top = climbed.join(up.select("at"), "at", "left_anti")
    # How many nodes of documentation there are from each node up, itself among them.
    within = sums_to_root(nodes.select("node", "parent", F.coalesce(F.col("kind").isin(*DOCUMENTATION), F.lit(False)).cast("int").alias("weight")), "usages-documentation")
    documented = within.filter("total > 0").select("node")
    mark = refs.select("ref", "node").join(documented, "node", "left_semi").select("ref", F.lit(True).alias("doc"))
    around = _around(top.join(refs.select("ref", "is_static"), "ref").join(mark, "ref", "left"), nodes)
    kind: Column = F.when(F.col("doc"), "Documentation").when(F.col("is_static") & (F.col("p_kind") == "SimpleMemberAccessExpression") & (F.col("slot") == "Expression"), "StaticMemberAccess")
    kind = kind.when((F.col("p_kind") == "VariableDeclaration") & (F.col("slot") == "Type") & (F.col("g_kind") == "FieldDeclaration"), "FieldType")
    for name, kinds, slot in TYPE_CLASSES:
        kind = kind.when(F.col("p_kind").isin(*kinds) & (F.lit(True) if slot is None else F.col("slot") == slot), name)
    return around.select("ref", kind.otherwise("Other").alias("classification"))


def property_writes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to properties that write them, and how (ref, classification); reads have no row.

    Object initialisers (of copies too), assignments to the name or to a member
    access that holds it, and arguments passed by ``out`` or ``ref``.
    """
    around = _around(refs.select("ref", F.col("node").alias("at")), nodes)
    assigned = F.col("p_kind").endswith("AssignmentExpression") & (F.col("slot") == "Left")
    through = (F.col("p_kind") == "SimpleMemberAccessExpression") & F.col("g_kind").endswith("AssignmentExpression") & (F.col("p_slot") == "Left")
    kind = F.when(assigned & F.col("g_kind").endswith("InitializerExpression"), "ObjectInitializer").when(assigned | through, "Assignment")
    kind = kind.when((F.col("p_kind") == "Argument") & F.col("p_modifier").isin("out", "ref"), "OutRef")
    return around.select("ref", kind.alias("classification")).filter("classification is not null")


def reflection_calls(calls: DataFrame, type_ofs: DataFrame) -> DataFrame:
    """Calls of known methods of reflection, and ``typeof``, at their sites (site, kind, argument).

    ``calls``: site, namespace, type, method, argument (the first type argument
    or null); ``type_ofs``: site, argument.  Methods are known by the whole of
    their names, never by a part of a text; the first row of the table counts.
    """
    rules = calls.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(REFLECTION)], "ns string, t string, m string, kind string, ord int")
    on = (F.col("method") == F.col("m")) & (F.col("ns").isNull() | (F.col("namespace") == F.col("ns"))) & (F.col("t").isNull() | (F.col("type") == F.col("t")))
    hit = calls.join(F.broadcast(rules), on)  # as many rows as the table has
    known = hit.groupBy("site", "namespace", "type", "method", "argument").agg(F.min(F.struct("ord", "kind")).alias("k")).select("site", "k.kind", "argument").distinct()
    return known.unionByName(type_ofs.select("site", F.lit("typeof").alias("kind"), "argument"))
