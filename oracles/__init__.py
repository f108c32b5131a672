"""SQL equivalents of the registered queries."""

from oracles.compose import statement
from oracles.finals import FINALS

ORACLES: dict[str, str] = {name: statement(sql) for name, sql in FINALS.items()}
