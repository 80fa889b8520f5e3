"""Facts of source files as Column expressions over their path, text and imports, and of projects over their file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.text import has_any

# Names by which a framework is known among the imports, first match first.
_SCRIPT_FRAMEWORKS = {"react": ["react", "react-dom"], "angular": ["@angular/core"], "vue": ["vue"], "express": ["express"], "nestjs": ["@nestjs/core"], "nextjs": ["next"]}
FRAMEWORKS = {
    "python": {"django": ["django", "rest_framework"], "flask": ["flask"], "fastapi": ["fastapi", "pydantic"], "pytest": ["pytest"], "tensorflow": ["tensorflow", "keras"], "pytorch": ["torch", "torchvision"]},
    "javascript": _SCRIPT_FRAMEWORKS,
    "typescript": _SCRIPT_FRAMEWORKS,
    "java": {"spring": ["springframework"], "hibernate": ["hibernate"], "junit": ["junit", "jupiter"]},
}

# What a file is for by words of its path, and a module by words of its name, first match first.
FILE_ROLES = {
    "test": ["test"],
    "model": ["model", "schema", "entity"],
    "view": ["view", "component", "ui"],
    "controller": ["controller", "handler", "route"],
    "service": ["service", "manager", "provider"],
    "utility": ["util", "helper", "common"],
    "configuration": ["config", "settings"],
}
MODULE_ROLES = FILE_ROLES | {"service": ["service", "business", "logic"]}

# Files of a project's top directory that tell its build system, test framework and linters, first match first.
BUILD_FILES = {
    "npm": "package.json", "yarn": "yarn.lock", "pnpm": "pnpm-lock.yaml", "pip": "requirements.txt", "poetry": "poetry.lock", "maven": "pom.xml",
    "gradle": "build.gradle", "make": "Makefile", "cmake": "CMakeLists.txt", "cargo": "Cargo.toml", "go": "go.mod",
}
TEST_FILES = {
    "python": {"pytest": ["pytest.ini", "conftest.py", "pytest.config"], "unittest": ["test_*.py"], "nose": ["nose.cfg"]},
    "javascript": {"jest": ["jest.config.js", "jest.config.json"], "mocha": ["mocha.opts", ".mocharc.json"], "jasmine": ["jasmine.json"], "vitest": ["vitest.config.js", "vitest.config.ts"]},
    "java": {"junit": ["*Test.java", "*Tests.java"], "testng": ["testng.xml"]},
}
LINTER_FILES = {"python": [".flake8", "setup.cfg", "pyproject.toml", ".pylintrc"], "javascript": [".eslintrc", ".eslintrc.json", ".eslintrc.js", "eslint.config.js"]}


def _groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _first(hits: list[tuple[Column, str]]) -> Column:
    """The name of the first hit, null if none holds."""
    return F.coalesce(*[F.when(hit, name) for hit, name in hits])


def imports(content: Column, language: Column) -> Column:
    """Modules that a file imports, each once: Python's import and from lines, else import, bare import and require. Null counts as empty."""
    listed = F.flatten(F.transform(_groups(content, r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"), lambda names: F.transform(F.split(names, ","), lambda n: F.regexp_extract(F.trim(n), r"^([\w.]+)", 1))))
    python = F.concat(listed, _groups(content, r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b"))
    script = F.concat(
        _groups(content, r"""(?m)^[ \t]*import[ \t]+[^'"\n]+?[ \t]+from[ \t]+['"]([^'"\n]+)['"]"""),
        _groups(content, r"""(?m)^[ \t]*import[ \t]+['"]([^'"\n]+)['"]"""),
        _groups(content, r"""require\(['"]([^'"\n]+)['"]\)"""),
    )
    return F.array_distinct(F.filter(F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>")), lambda n: n != ""))


def framework(language: Column, imported: Column) -> Column:
    """The first framework of the language that the imports name; null if none."""
    low = F.lower(F.concat_ws(" ", imported))
    return _first([((language == lang) & has_any(low, names), name) for lang, known in FRAMEWORKS.items() for name, names in known.items()])


def file_role(path: Column) -> Column:
    """What a file is for by its path; null if nothing tells."""
    return _first([(has_any(F.lower(path), names), role) for role, names in FILE_ROLES.items()])


def module_role(name: Column) -> Column:
    return F.coalesce(_first([(has_any(F.lower(name), names), role) for role, names in MODULE_ROLES.items()]), F.lit("general"))


def requirements(content: Column) -> Column:
    """The names before == in a requirements file, in order; comments and blank lines are no names."""
    lines = F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    return F.transform(lines, lambda x: F.trim(F.split_part(x, F.lit("=="), F.lit(1))))


def package_dependencies(content: Column) -> Column:
    """The keys of dependencies and devDependencies in a package.json; none where it can't be read."""
    keys = [F.coalesce(F.json_object_keys(F.get_json_object(content, f"$.{field}")), F.array().cast("array<string>")) for field in ("dependencies", "devDependencies")]
    return F.concat(*keys)


def history(log: Column) -> Column:
    """Changes (commit, author, email, date, message) of a log with one line each and bars between; lines with fewer parts are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda line: F.split(line, r"\|")), lambda p: F.size(p) >= 5)
    return F.transform(parts, lambda p: F.struct(*[p[n].alias(name) for n, name in enumerate(["commit", "author", "email", "date", "message"])]))


def entities(query: Column) -> Column:
    """Names that a query may mean, each once, in order: called, defined, imported, either side of a dot, and words that are identifiers."""
    found = [_groups(query, p) for p in (r"\b(\w+)\s*\(", r"(?i)class\s+(\w+)", r"(?i)from\s+(\w+)", r"(?i)import\s+(\w+)", r"(\w+)\.\w+")]
    after_dot = _groups(query, r"\w+\.(\w+)")
    own = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & (F.length(w) > 2))
    return F.array_sort(F.array_distinct(F.concat(*found, after_dot, own)))


def path_entities(path: Column) -> Column:
    """The name of a file, and without underscores and in camel case if it has any."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(py|js)", "")
    parts = F.split(name, "_")
    camel = F.concat(parts[0], F.concat_ws("", F.transform(F.slice(parts, 2, 1_000_000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000))))))
    return F.when(F.contains(name, F.lit("_")), F.array_distinct(F.array(name, F.replace(name, F.lit("_"), F.lit("")), camel))).otherwise(F.array(name))


def project_facts(files: DataFrame, project: str, path: str) -> DataFrame:
    """One row per project from its file list (paths relative to its top): project_type, build_system, test_framework and linter by language.

    One aggregation of a flag for each marker, so its state has a fixed size for
    projects of any number of files. Null paths are no files.
    """
    p = F.col(path)
    flags: dict[str, Column] = {}

    def seen(name: str) -> Column:
        """Whether a top file, or with a star a file anywhere, of that name is there."""
        alias = f"_{len(flags)}"
        key = next((k for k, v in named.items() if v == name), alias)
        if key == alias:
            named[alias] = name
            like = "(^|/)" + name.replace(".", r"\.").replace("*", "[^/]*") + "$"
            flags[alias] = F.bool_or(p.rlike(like) if "*" in name else (p == name) | F.startswith(p, F.lit(name + "/"))).alias(alias)
        return F.coalesce(F.col(key), F.lit(False))

    named: dict[str, str] = {}
    any_of = lambda names: F.greatest(*[seen(n) for n in names]) if len(names) > 1 else seen(names[0])
    kind = (
        F.when(any_of(["Dockerfile", "docker-compose.yml"]) & any_of(["api", "service", "services"]), "microservice")
        .when(seen("manage.py"), "monolith")
        .when(any_of(["setup.py", "pyproject.toml"]), "library")
        .when(any_of(["cli.py", "main.py", "__main__.py"]), "cli")
        .otherwise("application")
    )
    columns = {"project_type": kind, "build_system": _first([(seen(file), system) for system, file in BUILD_FILES.items()])}
    for language, known in TEST_FILES.items():
        columns[f"{language}_tests"] = _first([(any_of(names), name) for name, names in known.items()])
    for language, names in LINTER_FILES.items():
        columns[f"{language}_linter"] = _first([(seen(name), name) for name in names])
    found = files.groupBy(project).agg(*flags.values())
    return found.select(project, *[c.alias(name) for name, c in columns.items()])
