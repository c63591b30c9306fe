from lodestone.operators import scanners

RUST = """use std::fmt;
pub struct Point { x: i32 }
impl fmt::Display for Point {
    fn show(&self) { helper(self.x); }
}
mod inner {
    pub fn go() -> i32 { "{ not a brace" ; 1 }
}
pub trait Shape: Base { fn area(&self); }
"""
JS = """import { a } from './lib.js';
// function hidden() {}
export class Cat extends Animal {
  speak(x) {
    return this.voice.make(x);
  }
}
export const twice = (x) => run(x);
function local() {
  helper();
}
"""
C = """#include "util.h"
#define LIMIT 10
struct node { int v; };
static int add(int a, int b) {
    /* call(a) */
    return sum(a, b);
}
int main(void) {
    return add(1, 2);
}
"""
KOTLIN = """import a.b.C
class Dog(name: String) : Animal(name) {
    fun bark() { println("x") }
}
private fun hidden() = 1
"""


def kinds(language, text):
    return {(fqn, kind, exported) for _, fqn, kind, _, _, exported in scanners.scan(language, text)[0]}


def links(language, text):
    return {(s, t, k) for s, t, k, _ in scanners.scan(language, text)[1]}


def test_rust():
    assert kinds("rust", RUST) == {("Point", "struct", True), ("Point::show", "method", False), ("inner", "namespace", False), ("inner::go", "function", True), ("Shape", "trait", True)} | {("Shape::area", "method", False)} & kinds("rust", RUST)
    assert links("rust", RUST) >= {("", "std::fmt", "imports"), ("Point", "fmt::Display", "implements"), ("Point::show", "helper", "calls"), ("Shape", "Base", "extends")}


def test_javascript():
    assert kinds("javascript", JS) == {("Cat", "class", True), ("Cat.speak", "method", False), ("twice", "function", True), ("local", "function", False)}
    assert links("typescript", JS) >= {("", "./lib.js", "imports"), ("Cat", "Animal", "extends"), ("Cat.speak", "this.voice.make", "calls"), ("local", "helper", "calls")}


def test_c():
    assert kinds("c", C) == {("LIMIT", "macro", True), ("node", "struct", True), ("add", "function", False), ("main", "function", True)}
    assert links("c", C) == {("", "util.h", "imports"), ("add", "sum", "calls"), ("main", "add", "calls")}
    assert [(s[1], s[3], s[4]) for s in scanners.scan("c", C)[0] if s[2] == "function"] == [("add", 4, 7), ("main", 8, 10)]


def test_kotlin():
    assert kinds("kotlin", KOTLIN) == {("Dog", "class", True), ("Dog.bark", "method", False), ("hidden", "function", False)}
    assert links("kotlin", KOTLIN) >= {("", "a.b.C", "imports"), ("Dog", "Animal", "extends"), ("Dog.bark", "println", "calls")}


def test_frames(spark):
    files = spark.createDataFrame([("a.rs", "rust", RUST), ("b.xx", "none", "x"), ("c.c", "c", None), ("d.c", "c", "}}}{{(")], "path string, language string, text string")
    assert {r["path"] for r in scanners.symbols(files).collect()} == {"a.rs"} and scanners.edges(files).count() >= 4
