"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from pitwall.functions.exprs import *  # noqa: F401,F403
