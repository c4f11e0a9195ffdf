import json

from strandgraph.functions.text import _repaired


def test_a_fault_far_before_the_end_keeps_what_stands_before_it():
    for after in (3, 400):
        rest = ", ".join(f'"k{i}": "v"' for i in range(after))
        got = json.loads(_repaired('{"a": ["x", "y"], "b": {"c": "d"}, "e" "f", ' + rest + "}"))
        assert (got["a"], got["b"]) == (["x", "y"], {"c": "d"})
