"""Valid code of every registered language in the forms people write, and the same with one thing wrong."""

import random

import pytest

from graphloom.llm import glr, syntax
from graphloom.llm.syntax_queries import checked_files

VALID = {
    "go": """package p

import (
	"fmt"
	m "math"
)

type Num interface {
	~int | ~float64
}

type Pair[K comparable, V any] struct {
	Key K `json:"key"`
	Val V
	*sync.Mutex
}

const (
	A = iota
	B
)

func (p *Pair[K, V]) Get(ctx context.Context, opts ...Option) (k K, err error) {
	ch := make(chan int, 3)
	go func() { ch <- 1 }()
	defer close(ch)
	select {
	case v, ok := <-ch:
		fmt.Println(v, ok)
	case ch <- 2:
	default:
		return
	}
	switch t := x.(type) {
	case int, *string:
		_ = t
	case nil:
	}
outer:
	for i, v := range []int{1, 2} {
		if v := f(i); v > 1 && !ok {
			continue outer
		} else if v == 0 {
			break
		}
	}
	s := map[string][]int{"a": {1, 2}, "b": nil}
	s["a"] = append(s["a"][1:2], p.vals[:]...)
	return Map[int, string](x, func(a int) string { return "x" }), nil
}
""",
    "javascript": """'use strict'
const { a, b: [c = 1, ...d] } = require('x'), re = /[/"]+/g
let t = `a ${b + `c ${d}`} e`
outer: for (const [k, v] of Object.entries(o)) { if (k) continue outer; else break }
if (a) b(); else c();
class A extends B {
  #x = 1
  static y = { z: 2, get w() { return 1 }, async *g() { yield* h() }, [q]: 3, 'r-s': 4 }
  constructor(...args) { super(...args) }
  static async m({ a, b } = {}) { await this.#x; return a?.b?.[c]?.(d) ?? e }
}
var f = async (x) => ({ ...x, y: x => x ** 2 })
do x++; while (x < 3)
switch (x) { case 1: case 2: y(); break; default: z() }
try { throw new Error('e') } catch { f() } finally { g() }
export default function () { return /a/.test(b) ? new.target : typeof c }
""",
    "typescript": """import type { A } from './a';
export abstract class R<T extends object = {}> implements I<T>, J {
  private readonly x?: Map<string, T[]> = new Map();
  constructor(public a: string, protected b = 1) { super(); }
  abstract m<K extends keyof T>(k: K, ...rest: unknown[]): T[K];
  @Input() set v(x: number | undefined) { this.x! = x as any; }
}
type M<T> = { readonly [K in keyof T]?: T[K] extends (infer U)[] ? U : never };
export function isA(x: unknown): x is A { return (<A>x).b !== undefined; }
declare module 'm' { export const z: typeof import('./z'); }
enum E { A = 1, B = 'b' }
const g = async <T,>(x: T): Promise<[T, number]> => [x, 1];
let o = { a: 1, b } satisfies Record<string, number>;
interface I { (a: string): void; new (b: number): I; c?(): this; [k: string]: unknown }
""",
    "java": """package a.b;
import static java.util.Map.*;
@Deprecated(since = "1")
public final class A<T extends Comparable<? super T>> extends B<T> implements C, D.E {
    private static final Map<String, List<int[]>> M = new HashMap<>();
    enum Color { RED(1), GREEN { void f() {} }; Color(int... x) {} }
    record Point(int x, int y) {}
    static { M.put("a", null); }
    @Override public <R> R go(final Function<? super T, ? extends R> f, int[]... xs) throws IOException {
        try (var in = open(); Reader r = new Reader(in)) {
            for (final String s : xs) { if (s instanceof String t && !t.isEmpty()) continue; else break; }
        } catch (IOException | RuntimeException e) { throw new X(e) { int y = 1; }; } finally { }
        Runnable r = () -> { }; Supplier<A> n = A::new; Object o = (Runnable & Serializable) () -> f.apply(null);
        int k = switch (x) { case 1, 2 -> 3; default -> { yield 4; } };
        char[] cs = new char[] {'a', '\\''}; int[][] g = new int[3][];
        label: do { x >>>= 1; y = a < b ? c : d; } while (i-- > 0);
        return this.<R>go(f).m((a, b) -> a + b);
    }
}
""",
    "c": """#include <stdio.h>
#define M(x) do { x; } while (0)
typedef struct node { struct node *next; unsigned flags : 3; union { int i; float f; } u; } node_t;
static int (*handlers[4])(const char *, void *) = { [0] = NULL, &h };
enum { A = 1, B = A << 2, };
#ifdef X
int only_x(void) {
#else
int not_x(void) {
#endif
    const char *s = "a" "b" PRIu64 "c";
    node_t n = { .next = 0, .u = { .i = 'x' } }, *p = &n;
    for (int i = 0, j; i < 3; i++, j--) if (p->next) goto end; else continue;
    do { *p++ = (node_t){ 0 }; } while (sizeof(int *) * 2 > (size_t) -1);
    switch (x) { case 1 ... 3: case 'a': return -1; default: break; }
end:
    return a ? b : (int) c;
}
extern void f(int, char *argv[], ...) __attribute__((noreturn));
""",
    "cpp": """#include <vector>
namespace a::b {
template <typename T, int N = 3, class... Args> class V : public Base<T>, private virtual D {
 public:
    explicit V(int x) noexcept : Base<T>(x), y_{1} {}
    virtual ~V() = default;
    V &operator=(const V &) = delete;
    auto begin() const -> decltype(x_) { return x_; }
    template <class U> friend bool operator==(const V<U> &, const V &);
 private:
    std::map<std::string, std::vector<int>> m_;
};
using Fn = std::function<void(int, const char *)>;
int f(std::unique_ptr<T> &&p, int (&a)[3]) {
    for (const auto &[k, v] : m) if (auto it = m.find(k); it != m.end()) return it->second;
    auto l = [&, this, x = 1](auto &&y) mutable -> int { return static_cast<int>(y) + x; };
    try { throw std::runtime_error(R"(a"b)"); } catch (const std::exception &e) { delete[] q; } catch (...) {}
    int x = 1'000, *q = new int[3]{1, 2, 3};
    return sizeof...(Args) + (args + ...);
}
enum class E : unsigned char { A = 1, B };
}
""",
    "csharp": """using System.Collections.Generic;
namespace A.B {
    [Serializable, X(1, Y = 2)]
    public sealed class C<T> : D<T>, IE where T : class, new() {
        public int P { get; private set; } = 3;
        public string Q => $"a {P + 1} b";
        event EventHandler<int> E;
        public C(int x = 1, params string[] s) : base(x) { }
        public async Task<List<T>> M<U>(ref int a, out U b) {
            foreach (var (k, v) in d) { if (v is string { Length: > 3 } s && s != null) continue; }
            var q = x switch { 1 => "a", > 2 and < 5 => "b", _ => throw new E() };
            using var f = await Open(@"c:\\x""y");
            Func<int, int> g = y => y * 2; a ??= b?.c?[1] ?? default(int);
            try { lock (this) { } } catch (E e) when (e.X > 1) { throw; } finally { }
            return new List<T> { new T(), [1] = 2 };
        }
    }
    enum F : byte { A = 1, B }
    record R(int X, string Y);
}
""",
    "rust": """#![allow(dead_code)]
use std::{collections::HashMap, fmt::{self, Display as D}};
#[derive(Debug, Clone)]
pub struct S<'a, T: 'a + Clone = u8> where T: Send { pub(crate) x: &'a [T], y: Option<Box<dyn Fn(i32) -> T + 'static>> }
enum E { A(u8, String), B { x: i32 }, C = 3 }
impl<'a, T> Iterator for S<'a, T> where T: Clone + Send {
    type Item = (T, u8);
    fn next(&mut self) -> Option<Self::Item> {
        let Some(x) = self.x.first() else { return None };
        let v: Vec<_> = (0..=10).map(|i| i * 2).filter(move |&x| x > 1).collect::<Vec<_>>();
        match v.as_slice() { [a, .., b] if a < b => println!("{} {:?}", a, b), [] | [_] => {} _ => unreachable!() }
        'outer: loop { while let Some(y) = it.next() { if y == 'c' as u8 { break 'outer; } } }
        let s = r#"a"b"#; let t = S { x, ..Default::default() };
        unsafe { *p += 1 }
        Ok(x?.await)
    }
}
macro_rules! m { ($x:expr) => { $x + 1 }; }
""",
    "php": """<html><?php
namespace A\\B;
use C\\{D, E as F};
abstract class G extends H implements I {
    use T;
    const X = 1;
    private ?int $y = null;
    public function __construct(private readonly array $a = [], ?string ...$rest) { parent::__construct($a); }
    abstract protected static function f(int|string $x): ?array;
}
function &g(array $p, $q = ['a' => 1, 2]) {
    foreach ($p as $k => [$a, $b]) { if ($k === "x {$a['b']}") continue; elseif ($a) echo $b, 1; else break; }
    $f = fn($x) => $x ** 2; $h = function () use (&$q) { return $this->a?->b()::C; };
    $s = <<<EOT
text $x
EOT;
    try { $o = new class(1) extends Z {}; } catch (A | B $e) { throw $e; } finally { unset($x[1]); }
    return match(true) { $a, $b => 1, default => null } ?? $c ?: (int) $d;
}
?>
<p><?= $x ?></p>
""",
    "scala": """package a.b
import scala.collection.{mutable => m, _}
case class P[T <: A](x: Int, y: List[T] = Nil)(implicit e: E) extends B(x) with C {
  private lazy val z: Map[String, Int] = Map("a" -> 1)
  def f[U](g: Int => U, h: => Int*): Option[U] = x match {
    case 0 | 1 if y.isEmpty => None
    case n: Int =>
      val q = n + 1
      Some(g(q))
    case _ => throw new E("x")
  }
  for { a <- xs; if a > 1; b = a * 2 } yield a + b
  override def toString = s"a ${x + 1}"
  var w = if (x > 1) "y" else "n"
  xs.map(_ + 1).foreach { case (k, v) => println(k) }
}
object O extends App
""",
    "python": """import a.b as c, d
from . import (e, f as g,)
@dec(1)
async def h(x: int, /, *a: str, k=1, **kw) -> "T":
    async with o as p, q: yield [*x, *y], {**z, 'a': 1}
    if (n := len(x)) > 1: return lambda u, *v: u
    x[1:2, ::3], (y, *w) = z = 1, 2
    match x:
        case {"a": [1, _], **r} if r: pass
        case A(b=1) | None as m: del x[0]
    try:
        raise E from None
    except (A, B) as e:
        print(f"{x!r:>{w}}", sep='', *a)
    else:
        assert x, "y"
    finally:
        global G
class K(Base, metaclass=M):
    a: int = 1; b = not a in c
    def f(self): return (await x async for x in y if not z)
""",
    "ruby": """require 'x'
module A::B
  class C < D
    attr_reader :a, :b
    def f(x, y = 1, *z, k: 2, **o, &blk)
      return if x.nil? && !y
      %w[a b].each_with_index do |v, i|
        puts "a #{v['k']} b" unless v =~ /x\\/y/
      end
      h = { a: 1, 'b' => 2, :c => -> (q) { q + 1 } }
      z.map { |v| v&.to_s }.select(&:x?).first
      case x
      when 1, 2 then y
      when String
        raise ArgumentError, "x"
      else z
      end
    rescue E => e
      @a ||= e
    ensure
      self.b = <<~T
        text
      T
    end
  end
end
""",
}
#: One thing changed in the code above, or code of its own.
BROKEN = {
    "go": [("ch := make(chan int, 3)", "ch := make(chan int 3)"), ("A = iota", "A = = iota"), ("} else if", "}\n\telse if"), (", nil\n}", ", nil\n")],
    "javascript": [("const { a,", "const { a b,"), ("new Error('e')", "new Error('e'"), ("y: x => x ** 2", "y: x => => 2"), ("static y =", "static y z =")],
    "typescript": [("export abstract class", "export abstract klass x"), ("enum E { A = 1,", "enum E { A = 1 2,"), ("x?: Map<string, T[]>", "x?: Map<string T[]>")],
    "java": [("case 1, 2 -> 3;", "case 1, 2 -> ;"), ("int k =", "int int k ="), ("throws IOException {", "throws {"), ("new HashMap<>()", "new HashMap<>(")],
    "c": [("return -1;", "return -1 2;"), ("n = {", "n = = {"), ("goto end;", "goto;"), ("A << 2,", "A <<,")],
    "cpp": [("return it->second;", "return it->;"), ("int x = 1'000,", "int x = = 1,"), ("= delete;", "= = delete;"), ("return x_; }", "return 1 1; }")],
    "csharp": [("var q = x switch", "var q = = x switch"), ("foreach (var (k, v) in d)", "foreach (var (k, v) d)"), ("return new List<T>", "return return List<T>")],
    "rust": [("let s = r", "let s = = r"), ("if a < b =>", "if a < =>"), ("let t = S", "let = S"), ("(0..=10)", "(0..=10")],
    "php": [("const X = 1;", "const X = = 1;"), ("echo $b, 1;", "echo $b 1;"), ("private ?int $y", "private ?int y"), ("return match(true) {", "return match(true) { 1")],
    "scala": [("val q = n + 1", "val = 1"), ("def f[U](", "def f[U(("), ("var w = if (x > 1)", "var w = = if (x > 1)")],
    "python": [("f(self): return", "f(self) return"), ("sep='', *a", "sep='', a"), ("= z = 1, 2", "= 1 = z"), ("        raise E from None", "        raise E from None\n      x = 1")],
    "ruby": [("raise ArgumentError, \"x\"", "raise ArgumentError, , \"x\""), ("    ensure\n", "    end\n    ensure\n"), ("h = {", "h = = {")],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    assert [(p.line, p.what) for p in syntax.problems(language, VALID[language].encode())] == []


@pytest.mark.parametrize(("language", "old", "new"), [(k, *c) for k, cs in BROKEN.items() for c in cs])
def test_broken(language, old, new):
    assert VALID[language].count(old) >= 1
    broken = VALID[language].replace(old, new, 1)
    found = syntax.problems(language, broken.encode())
    assert found and sum(p.cost for p in found) >= 1


def test_where_and_how_much():
    text = "".join(f"let a{k} = f({k});\n" for k in range(30)) + "let b = (1 2);\n" + "".join(f"let c{k} = = {k};\n" for k in range(7))
    found = syntax.problems("javascript", text.encode())
    assert [p.line for p in found] == [*range(31, 39)] and sum(p.cost for p in found) == 8
    assert syntax.cause(syntax.problems("c", b"int f(void) {\n    return 1;\n"), "int f(void) {\n    return 1;\n") == "truncated"


def test_much_of_another_language():
    words = "it was then that of a road by three houses with so many kinds and no one there".split()
    text = "".join(" ".join(words[(k * j) % len(words)] for j in range(1, 4 + k % 9)) + (" ;" if k % 3 else " .") + "\n" for k in range(12_000))
    found = syntax.problems("java", text.encode())
    assert found and syntax.cause(found, text) == "other-language"


def test_edits_do_not_depend_on_size(spark):
    # 700 different units of two edits each, over 10,000 tokens: none counts less because of those before it
    units = ["let a = " + " ".join(f"x {'+' if k >> j & 1 else '&&'}" for j in range(10)) + " f(y) = = = 3;\n" for k in range(700)]
    files = {"r/whole.js": units, "r/front.js": units[:100], "r/back.js": units[100:]}
    df = spark.createDataFrame([(p, bytearray("".join(u).encode())) for p, u in files.items()], "path string, content binary").coalesce(1)
    ext = spark.createDataFrame([(".js", "javascript")], "ext string, language string")
    edits = {r.path: r.edits for r in checked_files(df, ext).collect()}
    each = sum(p.cost for p in syntax.problems("javascript", units[0].encode()))
    assert each > 1 and edits == {p: each * len(u) for p, u in files.items()}


@pytest.mark.parametrize(("language", "before", "after"), [("javascript", "let a = [", "];\n"), ("java", "class A { int[] a = {", "}; }\n"), ("c", "int a[] = {", "};\n"), ("python", "a = [", "]\n")])
def test_edits_of_one_long_unit(language, before, after):
    items = ["1 2" if k in (100, 7_900) else str(k) for k in range(8_000)]
    found = syntax.problems(language, (before + ", ".join(items) + after).encode())
    assert sum(p.cost for p in found) == 2


def test_edits_do_not_depend_on_files_before():
    inner = "try (0 * a * 0; A b = \"x\";) { f(); }"
    short = f"class A {{ void f() {{ {inner.replace('0 * a * 0', '0')} }} }}\n"
    broken = "class A { void f() { if (b) { int c = (0 * a * 0; A d = \"x\"; } } }\n"
    costs = []
    for before in ([], [short], [f"class A {{ void f() {{ {inner} }} }}\n", short, broken]):
        check = syntax.Checker("java")
        for text in before:
            check.quick(text)
            check.careful(text)
        costs.append([(p.cost, p.line, p.what) for p in check.careful(broken)])
    assert costs[0] and costs == [costs[0]] * 3


def test_repair_is_exact():
    grammar = glr.Recogniser("S: a S b | a b | S S | a = S | L ;\nL: a | L , a\n", ["S"], lambda c: frozenset([c]))
    words, signs = {""}, "ab=;,"
    for _ in range(9):
        words |= {w + c for w in words for c in signs if len(w) < 6}
    valid = [w for w in words if w and grammar.accepts("S", w)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 4)))
        least = min(distance(text, w) for w in valid)
        assert grammar.repair("S", text, 2) == (least if least < 3 else None), text
