"""Go source, by hand."""

import pytest

from driftlens.sources import go_signals, golang

CODE = '''// Package p
package p

import (
	"context"
	"net/http"
	th "github.com/x/things"
)

const GRID_SIZE, other = 60, "sixty"

var Verbs = map[string]int{"push": 2, "pull": 3}
var few = []string{"aa", "bb"}
var many = []string{"aa", "bb", "cc", "aa"}

type T[K comparable, V any] struct {
	a, b int `json:"a"`
	th.Thing
}

type R interface {
	Run(ctx context.Context) error
	~int | string
}

func (t *T[K, V]) Load(ctx context.Context, a, b int, rest ...string) (*th.Thing, error) {
	t.state.size = a
	t.cache["key one"] = b
	t.count++
	t.total += t._impl.step
	x, err := fetch(ctx, "the text", t.field.sub)
	if err != nil {
		return nil, wrap("cannot " + `load it`, err)
	}
	if y := find(a); y != nil && len(rest) > GRID_SIZE {
		t.out = render(y)
	} else if a == 3 {
		for i := range rest {
			if i > 2 { t.deep = i }
		}
	} else {
	}
	switch v := x.(type) {
	case nil, *th.Thing:
		t.seen = append(t.seen, v)
	default:
	}
	t._impl.go_on()
	limit, name := -25, "label"
	go func() { select { case <-ctx.Done(): limit = 7 } }()
	return &th.Thing{Inner: 3}, Point{X: 1, Y: limit, Label: name}.err()
}

func plain(w http.ResponseWriter, r *http.Request) map[string]int { return map[string]int{"first": 1, "second": 22} }

func gone()
'''


def test_functions():
    load, plain = go_signals.go_functions("p/a.go", CODE)
    assert (load["qualname"], load["name"], load["sig"]) == ("T.Load", "Load", "(context,int,int,...string)=>(*th.Thing,error)")
    assert load["strings"] == ["cannot", "key one", "label", "load it", "the text"] and load["decl_consts"] == load["consts"] == ["GRID_SIZE"]
    assert load["writes"] == ["cache[]", "count", "deep", "out", "seen", "state.size", "total"]
    assert load["reads"] == ["Thing", "_impl", "_impl.step", "cache", "count", "field", "field.sub", "state", "total"]
    assert load["calls"] == ["Done", "append", "err", "fetch", "find", "go_on", "len", "render", "wrap"] and load["delegates"] and load["ret_keys"] == []
    s = load["call_result_shapes"]
    assert s["fetch"] == ["arg-count:3", "ret-err-checked"] and s["wrap"] == ["arg-count:2", "ret-returned"] and s["find"] == ["arg-count:1"]
    assert s["len"] == ["arg-count:1", "ret-compared"] and s["render"] == ["arg-count:1", "ret-assigned-field"]
    assert plain["sig"] == "(http,http)=>map[string]int" and plain["ret_keys"] == ["first", "second"] and plain["n_lines"] == 1 and not plain["delegates"]
    assert CODE.split("\n")[load["line"] - 1].startswith("func (t") and CODE.split("\n")[load["line"] + load["n_lines"] - 2] == "}"
    assert plain["node_count"] == 12  # block, return, literal, its type with two names, two pairs of two


def test_tables_branches_values():
    tables = {t["name"]: (t["ret_keys"], t["strings"]) for t in go_signals.go_tables("a.go", CODE)}
    assert tables == {"Verbs": (["pull", "push"], []), "many": (["aa", "bb", "cc"], [])}
    arms = go_signals.go_branches("a.go", CODE)
    lines = CODE.split("\n")
    assert [lines[a["line"] - 1].strip() for a in arms] == ["if err != nil {", "if y := find(a); y != nil && len(rest) > GRID_SIZE {", "} else if a == 3 {", "case nil, *th.Thing:", "go func() { select { case <-ctx.Done(): limit = 7 } }()"]
    assert [a["writes"] for a in arms] == [[], ["out"], ["deep"], ["seen"], []] and [a["qualname"].rsplit(".", 1)[1] for a in arms] == list("12345") and all(a["name"] == "Load" for a in arms)
    values = [(v["qualname"].split("#")[0], v["value"]) for v in go_signals.go_values("a.go", CODE)]
    assert values == [("GRID_SIZE", "60"), ("other", "sixty"), ("push", "2"), ("pull", "3"), ("T.Load.limit", "-25"), ("T.Load.name", "label"), ("T.Load.limit", "7"), ("T.Load.Inner", "3"), ("plain.second", "22")]


@pytest.mark.parametrize("bad", ["", "func x() {}", "package p\nfunc {", "package p\nvar x = (", 'package p\nvar s = "open', "package p\nfunc f() { if { } }", "package p\nvar x = " + "(" * 5000])
def test_broken(bad):
    assert go_signals.go_functions("a.go", bad) == go_signals.go_tables("a.go", bad) == go_signals.go_branches("a.go", bad) == go_signals.go_values("a.go", bad) == []


def test_forms():
    body = "a.b(c...); x[i:j:k] = y[1]; m := map[string][]T{\"k\": {{1, 2}, {A: 3}}}; for ; ; { break }; for i := 0; i < n; i++ {}; L: for { continue L }; ch <- <-in; defer f(); if (T{}) == t {}; z := f[int, string](q); var e interface{ M() }; _, _, _ = m, z, e; switch { case a < b, c: fallthrough; default: }; func() {}(); type q = []int; w := struct{ A int }{3}; for range 10 {}; x.(T).y, *p = 1, -2i"
    tree = golang.parse(f"package p\nfunc f() {{ {body} }}\n")
    kinds = [k.kind for k in tree.kids[0].body.body]
    assert kinds == ["plain", "assign", "assign", "for", "for", "labeled", "send", "defer", "if", "assign", "declared", "assign", "switch", "plain", "declared", "assign", "for", "assign"]
    assert golang.unquoted(r'"a\tb\x41é\101\""') == 'a\tbAéA"' and golang.unquoted("`a\\n\r`") == "a\\n"
