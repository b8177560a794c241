"""Column expressions (JVM side, codegen friendly) shared by the operators."""

from foldwise.functions.hashing import seeded_key  # noqa: F401
