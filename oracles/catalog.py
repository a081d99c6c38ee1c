"""All SQL twins."""

from oracles import core, evidence, paper, portfolios, records, research, selection

SQL = {**core.SQL, **evidence.SQL, **selection.SQL, **portfolios.SQL, **paper.SQL, **research.SQL, **records.SQL}
