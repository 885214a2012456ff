"""JavaScript JSON semantics of the Python-lane helpers."""

import pytest

from quarry.functions import jsvalues as j


@pytest.mark.parametrize("x,text", [
    (1.0, "1"), (1.5, "1.5"), (-0.5, "-0.5"), (0.1, "0.1"), (100.0, "100"), (1e21, "1e+21"),
    (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"),
    (1.2345e-5, "0.000012345"), (12345678901234567890.0, "12345678901234567000"), (5e-324, "5e-324"),
    (1.7976931348623157e308, "1.7976931348623157e+308"), (-0.0, "0"), (123.456, "123.456")])
def test_number_text(x, text):
    assert j.number_text(x) == text


def test_loads_and_dumps():
    assert j.dumps(j.loads('{"b":1,"2":[1.0,"x",null,true],"1":{"z":1e3},"b":2}')) == \
        '{"1":{"z":1000},"2":[1,"x",null,true],"b":2}'
    assert j.dumps(j.loads("12345678901234567890")) == "12345678901234567000"
    assert j.dumps(j.loads("1E400")) == "null"                    # Infinity stringifies as null
    ok, value = j.loads_plain('{"a":[1,"x"],"b":{"c":null}}')
    assert ok and j.compact(value) == '{"a":[1,"x"],"b":{"c":null}}'
    assert j.loads_plain('{"a":1.5}') == (False, None)          # floats take the exact path
    assert j.loads_plain('{"10":1}') == (False, None)           # index-like keys too
    assert j.record_text({"b": "1", "10": None, "2": "x"}) == '{"2":"x","10":null,"b":"1"}'
    with pytest.raises(ValueError):
        j.loads("NaN")
