"""All registered queries."""

from barloom.plans import core, evidence, paper, portfolios, records, research, selection

QUERIES = {**core.QUERIES, **evidence.QUERIES, **selection.QUERIES, **portfolios.QUERIES, **paper.QUERIES, **research.QUERIES, **records.QUERIES}
