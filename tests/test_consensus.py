"""Shuffles of the molecule consensus."""

from __future__ import annotations

from strandlake.operators import consensus
from strandlake.standins import view


def test_a_molecule_is_made_by_one_shuffle(spark):
    """Alleles, strands and molecules were shuffled one after the other."""
    bases = view(spark, "/root/testdata/sf0.001", "bases_v")
    for made in (consensus.graded_molecules(bases), consensus.consensus_molecules(bases), consensus.disagreements(bases, "A")):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
