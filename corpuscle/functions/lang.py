"""Languages, formats and presets by file extension, as small lookup expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.display import basename, extension
from corpuscle.functions.text import col

#: Id, name, category and extensions of each language.
LANGUAGES = """
rust|Rust|programming|rs
python|Python|programming|py pyi pyx pyw
javascript|JavaScript|programming|js jsx mjs cjs
typescript|TypeScript|programming|ts tsx mts cts
go|Go|programming|go
java|Java|programming|java
kotlin|Kotlin|programming|kt kts
scala|Scala|programming|scala sc
swift|Swift|programming|swift
objective-c|Objective-C|programming|m mm
c|C|programming|c h
cpp|C++|programming|cpp cc cxx hpp hh hxx inl
csharp|C#|programming|cs
fsharp|F#|programming|fs fsi fsx
ruby|Ruby|programming|rb rake gemspec
php|PHP|programming|php php3 php4 php5 phtml
perl|Perl|programming|pl pm perl
lua|Lua|programming|lua
r|R|programming|r rmd
julia|Julia|programming|jl
dart|Dart|programming|dart
elixir|Elixir|programming|ex exs
erlang|Erlang|programming|erl hrl
haskell|Haskell|programming|hs lhs
ocaml|OCaml|programming|ml mli re rei
clojure|Clojure|programming|clj cljs cljc edn
zig|Zig|programming|zig
nim|Nim|programming|nim
v|V|programming|v
d|D|programming|d
crystal|Crystal|programming|cr
solidity|Solidity|programming|sol
move|Move|programming|move
assembly|Assembly|programming|asm s
vim|Vim Script|programming|vim
shell|Shell|shell|sh bash zsh fish
powershell|PowerShell|shell|ps1 psm1 psd1
sql|SQL|query|sql
graphql|GraphQL|query|graphql gql
markdown|Markdown|markup|md markdown
html|HTML|markup|html htm xhtml
css|CSS|markup|css
scss|SCSS|markup|scss sass
latex|LaTeX|markup|tex latex
rst|reStructuredText|markup|rst
asciidoc|AsciiDoc|markup|adoc asciidoc
org|Org Mode|markup|org
vue|Vue|markup|vue
svelte|Svelte|markup|svelte
xml|XML|data|xml xsl xslt xsd svg
json|JSON|data|json jsonc json5
yaml|YAML|data|yaml yml
toml|TOML|data|toml
protobuf|Protocol Buffers|data|proto
thrift|Thrift|data|thrift
dockerfile|Dockerfile|config|dockerfile
terraform|Terraform|config|tf tfvars hcl
nix|Nix|config|nix
cmake|CMake|config|cmake
make|Makefile|config|mk makefile
gradle|Gradle|config|gradle
bazel|Bazel|config|bzl bazel
mermaid|Mermaid|diagram|mmd mermaid
graphviz|Graphviz DOT|diagram|dot gv
plantuml|PlantUML|diagram|puml plantuml pu
d2|D2|diagram|d2
"""
CODE_CATEGORIES = ("programming", "shell", "query")
#: The extensions of the preset "code".
CODE_PRESET = """
rs py pyi pyx js jsx mjs cjs ts tsx go java kt kts scala sc swift m mm c h cpp cc cxx hpp hh hxx inl cs fs fsi fsx rb rake gemspec php pl pm perl lua r rmd jl dart ex exs erl hrl hs lhs ml mli re rei clj cljs cljc edn
zig v sol move asm s sh bash zsh fish sql graphql gql md tex latex rst adoc asciidoc org xml json jsonc yaml yml toml proto thrift dockerfile tf tfvars hcl nix cmake mk makefile gradle bzl bazel mmd mermaid dot gv puml
plantuml pu d2 mod sum xib storyboard plist xcconfig pro ninja vcxproj sln props targets csproj vbproj fsproj ld lds pc j2 jinja jinja2 hbs handlebars mustache tmpl template erb ejs tpl ini conf config txt dhall
containerfile vagrantfile gnumakefile justfile
"""
#: The extensions of the preset "docs".
DOCS_PRESET = "md txt rst adoc"
#: The extensions that are loaded as plain text (markdown, JSON and PDF apart).
TEXT_FORMAT = """
rs py pyi pyx js jsx mjs cjs ts tsx go java kt kts scala sc swift m mm c h cpp cc cxx hpp hh hxx inl fs fsi fsx rb rake gemspec pl pm perl lua r rmd jl dart ex exs erl hrl hs lhs ml mli re rei clj cljs cljc edn zig nim
v d cr sol move asm s vim sh bash zsh fish sql graphql gql tex latex rst adoc asciidoc org xml yaml yml toml proto thrift tf tfvars hcl cmake mk gradle bzl bazel mmd mermaid dot gv puml plantuml pu d2 mod sum xib
storyboard plist xcconfig pro ninja vcxproj sln props targets csproj vbproj fsproj ld lds pc j2 jinja jinja2 hbs handlebars mustache tmpl template erb ejs tpl ini conf config txt
"""
#: Directories that a walk never enters.
EXCLUDED = ".venv venv __pycache__ .tox .pytest_cache site-packages .eggs node_modules .npm .yarn .pnp .pnp.js target .cache build dist .next .nuxt .svelte-kit .git .svn .hg .vscode .idea .vs .DS_Store .docker data logs tmp temp".split()


@cache
def by_extension() -> dict[str, tuple[str, str, str]]:
    """extension -> (id, name, category)."""
    out = {}
    for line in LANGUAGES.strip().splitlines():
        i, name, cat, exts = line.split("|")
        out |= {e: (i, name, cat) for e in exts.split()}
    return out


@cache
def presets() -> dict[str, frozenset[str]]:
    return {"code": frozenset(CODE_PRESET.split()), "docs": frozenset(DOCS_PRESET.split())}


def expand_extensions(wanted: list[str]) -> list[str]:
    """Presets expanded, everything else as a literal in lower case; sorted, without repeats."""
    return sorted({x for w in wanted for x in presets().get(w.strip().lower(), {w.strip().lower().lstrip(".")})})


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, by a literal map."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: str | Column) -> Column:
    return _lookup(extension(path), {e: v[0] for e, v in by_extension().items()})


def language_name(path: str | Column) -> Column:
    return _lookup(extension(path), {e: v[1] for e, v in by_extension().items()})


def category(path: str | Column) -> Column:
    return _lookup(extension(path), {e: v[2] for e, v in by_extension().items()})


def is_code(path: str | Column) -> Column:
    return F.coalesce(category(path).isin(list(CODE_CATEGORIES)), F.lit(False))


def document_format(path: str | Column) -> Column:
    """pdf, markdown, json or text; null where the extension isn't supported."""
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin("md", "markdown"), "markdown").when(e.isin("json", "jsonc"), "json").when(e.isin(TEXT_FORMAT.split()), "text")


def excluded(path: str | Column, by_suffix: bool = False) -> Column:
    """Whether a path lies in, or is, a directory that walks leave out; by suffix too where wanted."""
    p, b = col(path), basename(path)
    inside = p.rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in EXCLUDED) + ")/")
    own = b.isin(EXCLUDED)
    if by_suffix:
        own = b.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in EXCLUDED) + ")$")
    return inside | own
