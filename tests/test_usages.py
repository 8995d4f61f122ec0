"""Classes of usages by small trees, writes, known calls, pages of places."""

from factloom.operators import diagnostics, graph, usages

NODES = "node int, parent int, kind string, slot string, modifier string"


def classes(spark, *trees, static=False):
    """The class of the innermost node of each chain of (kind, slot), outermost first."""
    rows, refs, n = [], [], 0
    for tree in trees:
        parent = None
        for kind, slot in tree:
            n += 1
            rows.append((n, parent, kind, slot, None))
            parent = n
        refs.append((len(refs), n, static))
    got = usages.type_usages(spark.createDataFrame(refs, "ref int, node int, is_static boolean"), spark.createDataFrame(rows, NODES)).collect()
    return [r["classification"] for r in sorted(got, key=lambda r: r["ref"])]


def test_type_usages(spark):
    name = ("IdentifierName", "Type")
    assert classes(
        spark,
        [("MethodDeclaration", None), ("IdentifierName", "ReturnType")],
        [("Parameter", None), ("NullableType", "Type"), ("ArrayType", "ElementType"), ("QualifiedName", "ElementType"), ("IdentifierName", "Right")],
        [("PropertyDeclaration", None), name],
        [("FieldDeclaration", None), ("VariableDeclaration", "Declaration"), name],
        [("LocalDeclarationStatement", None), ("VariableDeclaration", "Declaration"), name],
        [("TypeArgumentList", None), ("IdentifierName", "Arguments")],
        [("BaseList", None), ("SimpleBaseType", "Types"), name],
        [("CastExpression", None), name],
        [("AsExpression", None), ("IdentifierName", "Right")],
        [("AsExpression", None), ("IdentifierName", "Left")],
        [("IsExpression", None), ("IdentifierName", "Right")],
        [("ObjectCreationExpression", None), name],
        [("SingleLineDocumentationCommentTrivia", None), ("XmlElement", None), ("XmlCrefAttribute", None), ("Parameter", None), name],
        [("TypeCref", None)],
        [("IdentifierName", None)],
        [("NullableType", None), ("IdentifierName", "ElementType")],
        [("SimpleMemberAccessExpression", None), ("IdentifierName", "Expression")],
    ) == [
        "MethodReturnType", "MethodParameter", "PropertyType", "FieldType", "LocalVariable", "GenericArgument", "BaseType", "Cast", "Cast", "Other", "TypeCheck", "ObjectCreation", "Documentation", "Documentation", "Other",
        "Other", "Other",
    ]
    assert classes(spark, [("SimpleMemberAccessExpression", None), ("IdentifierName", "Expression")], [("SimpleMemberAccessExpression", None), ("IdentifierName", "Name")], static=True) == ["StaticMemberAccess", "Other"]


def test_property_writes(spark):
    rows = [
        (1, None, "SimpleAssignmentExpression", "Expressions", None), (2, 1, "IdentifierName", "Left", None), (3, 1, "IdentifierName", "Right", None),
        (4, None, "ObjectInitializerExpression", None, None), (5, 4, "SimpleAssignmentExpression", None, None), (6, 5, "IdentifierName", "Left", None),
        (7, None, "AddAssignmentExpression", None, None), (8, 7, "SimpleMemberAccessExpression", "Left", None), (9, 8, "IdentifierName", "Name", None), (10, 7, "SimpleMemberAccessExpression", "Right", None), (11, 10, "IdentifierName", "Name", None),
        (12, None, "Argument", None, "out"), (13, 12, "IdentifierName", "Expression", None), (14, None, "Argument", None, None), (15, 14, "IdentifierName", "Expression", None), (16, None, "IdentifierName", None, None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    refs = spark.createDataFrame([(f"r{k}", k) for k in (2, 3, 6, 9, 11, 13, 15, 16, 99)], "ref string, node int")
    assert {r["ref"]: r["classification"] for r in usages.property_writes(refs, nodes).collect()} == {"r2": "Assignment", "r6": "ObjectInitializer", "r9": "Assignment", "r13": "OutRef"}


def test_reflection_is_known_by_whole_names(spark):
    calls = [
        (1, "System", "Type", "GetType", None), (2, "System.Reflection", "MethodInfo", "Invoke", None), (3, "Own", "Type", "GetMethod", "int"), (4, "Own", "Type", "GetType", None), (5, "System", "Activator", "CreateInstanceOf", None),
        (6, "System.Reflection.Emit", "X", "Invoke", None), (7, None, "Type", "GetFields", None), (8, "System", None, "GetType", None), (1, "System", "Type", "GetType", None),
    ]
    got = usages.reflection_calls(spark.createDataFrame(calls, "site int, namespace string, type string, method string, argument string"), spark.createDataFrame([(9, "Dog")], "site int, argument string"))
    assert sorted((r["site"], r["kind"], r["argument"]) for r in got.collect()) == [(1, "Type.GetType", None), (2, "Reflection.Invoke", None), (3, "Type.GetMethod", "int"), (7, "Type.GetFields", None), (9, "typeof", "Dog")]


def test_pages_of_places_and_subtrees(spark):
    parts = {"a": spark.createDataFrame([(k % 7,) for k in range(20)], "id int"), "b": spark.createDataFrame([("x",)], "id string"), "none": spark.createDataFrame([], "id int")}
    got = sorted(map(tuple, graph.impact_rows(parts, offset=5, limit=3).collect()))
    assert got == [("a", "5", 7), ("a", "6", 7)]
    assert sorted(map(tuple, graph.impact_rows(parts, limit=1).collect())) == [("a", "0", 7), ("b", "x", 1)]
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y")], "child string, parent string")
    kinds = spark.createDataFrame([("a", "Block"), ("b", "If"), ("d", "Call")], "node string, kind string")
    assert sorted((r["node"], r["parent"], r["depth"], r["kind"]) for r in graph.subtree(edges, "a", kinds, 2).collect()) == [("a", None, 0, "Block"), ("b", "a", 1, "If"), ("c", "b", 2, None)]


def test_control_flow_points(spark):
    steps = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2), (2, 9), (9, 4), (4, 5), (8, 1), (1, None)], "src int, dst int")
    region = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (None,), (1,)], "node int")
    kinds = spark.createDataFrame([(3, "return"), (9, "return"), (5, "return"), (6, None)], "node int, kind string")
    got = sorted(map(tuple, graph.control_flow(steps, region, kinds, 1).collect()))
    assert got == [("entry", 1), ("entry", 4), ("exit", 1), ("exit", 2), ("return", 3), ("return", 5), ("unreachable", 4), ("unreachable", 5), ("unreachable", 6)]


def test_caught_pages(spark):
    found = spark.range(1, 8).selectExpr("id as site")
    for most, rows, truncated in ((3, 3, True), (7, 7, True), (8, 7, False), (None, 7, False), (-1, 7, False), (99_999, 7, False)):
        got = diagnostics.caught_page(found, ["site"], most).collect()
        assert [r["site"] for r in got] == list(range(1, rows + 1)) and {r["truncated"] for r in got} == {truncated}
    assert diagnostics.caught_page(found.limit(0), ["site"], 3).count() == 0
