"""Facts of files and projects on small examples."""

from pyspark.sql import functions as F

from loomquery.functions import code


def one(spark, value, made, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(made(F.col("x")).alias("y")).first().y


def test_imports_and_framework(spark):
    python = "import os, sys as s\n  import django.db\nfrom flask.app import Flask\n# import no\nimportant = 1\nfrom os import path\n"
    found = one(spark, python, lambda c: code.imports(c, F.lit("python")))
    assert found == ["os", "sys", "django.db", "flask.app"]
    script = "import React, { x } from 'react'\nimport './style.css'\nconst a = require(\"express\")\nimport type { T } from \"t\"\n"
    assert one(spark, script, lambda c: code.imports(c, F.lit("typescript"))) == ["react", "t", "./style.css", "express"]
    assert one(spark, None, lambda c: code.imports(c, F.lit("python"))) == [] and one(spark, "import os", lambda c: code.imports(c, F.lit("go"))) == []
    assert one(spark, ["os", "Django.db"], lambda c: code.framework(F.lit("python"), c), "array<string>") == "django"
    assert one(spark, ["next"], lambda c: code.framework(F.lit("typescript"), c), "array<string>") == "nextjs"
    assert one(spark, None, lambda c: code.framework(F.lit("python"), c), "array<string>") is None


def test_roles_and_dependencies(spark):
    assert [one(spark, p, code.file_role) for p in ("a/Test_model.py", "src/UserSchema.ts", "a/x.py", None)] == ["test", "model", None, None]
    assert [one(spark, p, code.module_role) for p in ("order_logic", "order_manager", None)] == ["service", "general", "general"]
    assert one(spark, "a==1\n# c\n\n b >= 2\n", code.requirements) == ["a", "b >= 2"]
    assert one(spark, '{"dependencies": {"x": "1"}, "devDependencies": {"y": "2", "z": "3"}}', code.package_dependencies) == ["x", "y", "z"]
    assert one(spark, "no json", code.package_dependencies) == [] and one(spark, None, code.requirements) == []
    assert [c.author for c in one(spark, "h|Ann|a@b|2024|fix: x|y\nbroken|line\n", code.history)] == ["Ann"]


def test_entities(spark):
    assert one(spark, "call parse_file( in class Reader of my.module", code.entities) == sorted({"parse_file", "Reader", "my", "module", "call", "class"})
    assert one(spark, None, code.entities) == []
    assert one(spark, "a/b/read_file_now.py", code.path_entities) == ["read_file_now", "readfilenow", "readFileNow"] and one(spark, "a/main.js", code.path_entities) == ["main"]


def test_project_facts(spark):
    rows = [("a", "Dockerfile"), ("a", "api/x.py"), ("a", "package.json"), ("a", "yarn.lock"), ("b", "manage.py"), ("b", "deep/test_x.py"), ("b", "sub/pytest.ini"), ("b", "setup.cfg"), ("c", None), ("d", "src/OrderTest.java"), ("d", "Makefile")]
    found = {r.project: r for r in code.project_facts(spark.createDataFrame(rows, "project string, path string"), "project", "path").collect()}
    assert (found["a"].project_type, found["a"].build_system) == ("microservice", "npm")
    assert (found["b"].project_type, found["b"].python_tests, found["b"].python_linter) == ("monolith", "unittest", "setup.cfg")
    assert (found["c"].project_type, found["c"].build_system, found["c"].java_tests) == ("application", None, None)
    assert (found["d"].java_tests, found["d"].build_system) == ("junit", "make")
