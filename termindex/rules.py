"""Shipped defaults: the fixed values every configuration table starts from.

Nothing here is logic. Each constant is a lookup table, word list or pattern
whose value decides results, so it is written out plainly, once, in natural
order. Users change any of them by passing their own rows to the operators
(see ``termindex.config``).
"""

from __future__ import annotations

# --- fixed values: kinds of each filetype, highest priority first ------------
KIND_ORDER = {
    "c": "guesmfdtv",
    "cpp": "cgstuedfm",
    "go": "pftsicmv",
    "haxe": "cfvet",
    "java": "cimegf",
    "javascript": "cCfmpo",
    "perl": "cps",
    "php": "cfdi",
    "python": "mfcv",
    "ruby": "mfc",
    "rust": "nsicgtmePfM",
    "sh": "fa",
    "vim": "acfv",
    "zig": "fTe",
    "zsh": "fa",
}

# --- fixed values: kind that is read as another kind -------------------------
KIND_EQUIVALENT = {
    "c": {"p": "f"},
    "cpp": {"p": "f"},
    "php": {"a": "i"},
    "ruby": {"F": "f"},
    "rust": {"P": "f"},
}

# --- fixed values: pattern borders used when a rule names none ---------------
DEFAULT_PREFIX = r"\C\<"
DEFAULT_SUFFIX = r"\>"

MEMBER_ACCESS = r"\%(\%(\>\|\]\|)\)\%(\.\|->\)\)\@5<="

# --- fixed values: (filetype, kind, group, prefix, suffix, allow_keyword) ----
# None means "use the default": the borders above, keywords allowed.
GROUP_RULES = [
    ("c", "g", "cEnumTypeTag", r"\%(enum\s\+\)\@5<=", None, None),
    ("c", "s", "cStructTag", r"\%(struct\s\+\)\@7<=", None, None),
    ("c", "u", "cUnionTag", r"\%(union\s\+\)\@6<=", None, None),
    ("c", "e", "cEnumTag", None, None, None),
    ("c", "d", "cPreProcTag", None, None, None),
    ("c", "m", "cMemberTag", MEMBER_ACCESS, None, None),
    ("c", "f", "cFunctionTag", None, None, None),
    ("c", "t", "cTypeTag", None, r"\>\%(\.\|->\)\@!", None),
    ("c", "R", "cFuncRef", r"\%(&\)\@1<=", None, None),
    ("c", "v", "cGlobalVar", None, None, None),
    ("cpp", "c", "cppClassTag", None, None, None),
    ("cpp", "g", "cppEnumTypeTag", None, None, None),
    ("cpp", "s", "cppStructTag", None, None, None),
    ("cpp", "t", "cppTypeTag", None, None, None),
    ("cpp", "u", "cppUnionTag", None, None, None),
    ("cpp", "e", "cppEnumTag", None, None, None),
    ("cpp", "d", "cppPreProcTag", None, None, None),
    ("cpp", "m", "cppMemberTag", MEMBER_ACCESS, None, None),
    ("cpp", "f", "cppFunctionTag", None, r"\>\%(\s*(\)\@=", None),
    ("go", "p", "goPackageTag", None, None, None),
    ("go", "c", "goConstantTag", None, None, None),
    ("go", "t", "goTypeTag", None, None, None),
    ("go", "s", "goStructTag", None, None, None),
    ("go", "i", "goInterfaceTag", None, None, None),
    ("go", "v", "goGlobalVarTag", None, None, None),
    ("go", "f", "goFunctionTag", None, r"\>\%(\s*(\|\s*:\?=\s*func\)\@=", None),
    ("go", "m", "goMemberTag", r"\%(\%(\>\|\]\|)\)\.\)\@5<=", None, None),
    ("haxe", "c", "haxeClassTag", None, None, None),
    ("haxe", "f", "haxeFunctionTag", None, None, None),
    ("haxe", "v", "haxeVariableTag", None, None, 0),
    ("haxe", "e", "haxeEnumTag", None, None, None),
    ("haxe", "t", "haxeTypeTag", None, None, None),
    ("java", "c", "javaClassTag", None, None, None),
    ("java", "i", "javaInterfaceTag", None, None, None),
    ("java", "m", "javaMethodTag", None, None, None),
    ("java", "e", "javaEnumTag", None, None, None),
    ("java", "g", "javaEnumTypeTag", None, None, None),
    ("java", "f", "javaFieldTag", None, None, None),
    ("javascript", "c", "javascriptClassTag", None, None, None),
    ("javascript", "C", "javascriptConstantTag", None, None, None),
    ("javascript", "f", "javascriptFunctionTag", None, None, None),
    ("javascript", "m", "javascriptMethodTag", None, None, None),
    ("javascript", "o", "javascriptObjectTag", None, None, None),
    ("javascript", "p", "javascriptPropTag", None, None, None),
    ("perl", "c", "perlConstantTag", None, None, None),
    ("perl", "p", "perlPackageTag", None, None, None),
    ("perl", "s", "perlFunctionTag", r"\%(\<sub\s\*\)\@<!\%(>\|\s\|&\|^\)\@<=\<", None, None),
    ("php", "c", "phpClassTag", None, None, 0),
    ("php", "d", "phpConstantTag", None, None, 0),
    ("php", "i", "phpInterfaceTag", None, None, 0),
    ("php", "f", "phpFunctionsTag", None, r"(\@=", None),
    ("python", "m", "pythonMethodTag", r"\(\.\|\<def\s\+\)\@<=", None, None),
    ("python", "f", "pythonFunctionTag", r"\%(\<def\s\+\)\@<!\<", None, None),
    ("python", "c", "pythonClassTag", None, None, None),
    ("python", "v", "pythonGlobalVarTag", None, None, None),
    ("ruby", "m", "rubyModuleTag", None, None, None),
    ("ruby", "c", "rubyClassTag", None, None, None),
    ("ruby", "f", "rubyMethodTag", None, None, None),
    ("rust", "n", "rustModuleTag", None, None, None),
    ("rust", "s", "rustStructTag", None, None, None),
    ("rust", "i", "rustTraitInterfaceTag", None, None, None),
    ("rust", "c", "rustImplementationTag", None, None, None),
    ("rust", "g", "rustEnumTag", None, None, None),
    ("rust", "t", "rustTypeTag", None, None, None),
    ("rust", "m", "rustMemberTag", None, None, None),
    ("rust", "e", "rustEnumTypeTag", None, None, None),
    ("rust", "f", "rustFunctionTag", None, None, None),
    ("rust", "M", "rustMacroTag", None, None, None),
    ("sh", "f", "shFunctionTag", None, None, None),
    ("sh", "a", "shAliasTag", None, None, None),
    ("vim", "v", "vimVariableTag", None, None, None),
    ("vim", "a", "vimAutoGroupTag", None, None, None),
    ("vim", "c", "vimCommandTag", r"\(\(^\|\s\):\?\)\@<=", r"\(!\?\(\s\|$\)\)\@=", None),
    ("vim", "f", "vimFuncNameTag", r"\%(\%(g\|s\|l\):\)\=", None, None),
    ("zig", "e", "zigClassTag", None, None, None),
    ("zig", "f", "zigFunctionTag", None, None, None),
    ("zig", "T", "zigTypeTag", None, None, None),
    ("zsh", "f", "shFunctionTag", None, None, None),
    ("zsh", "a", "shAliasTag", None, None, None),
]

# --- fixed values: group links, from a language group to a base group --------
GROUP_LINKS = [
    ("cClassTag", "ClassTag"),
    ("cEnumTypeTag", "EnumTypeTag"),
    ("cStructTag", "StructTag"),
    ("cUnionTag", "UnionTag"),
    ("cFuncRef", "FunctionTag"),
    ("cGlobalVar", "GlobalVarTag"),
    ("cEnumTag", "EnumTag"),
    ("cFunctionTag", "FunctionTag"),
    ("cMemberTag", "MemberTag"),
    ("cPreProcTag", "PreProcTag"),
    ("cTypeTag", "TypeTag"),
    ("cppClassTag", "ClassTag"),
    ("cppEnumTypeTag", "EnumTypeTag"),
    ("cppStructTag", "StructTag"),
    ("cppUnionTag", "UnionTag"),
    ("cppEnumTag", "EnumTag"),
    ("cppFunctionTag", "FunctionTag"),
    ("cppMemberTag", "MemberTag"),
    ("cppPreProcTag", "PreProcTag"),
    ("cppTypeTag", "TypeTag"),
    ("goConstantTag", "ConstantTag"),
    ("goFunctionTag", "FunctionTag"),
    ("goInterfaceTag", "InterfaceTag"),
    ("goMemberTag", "MemberTag"),
    ("goPackageTag", "PreProcTag"),
    ("goStructTag", "StructTag"),
    ("goTypeTag", "TypeTag"),
    ("goGlobalVarTag", "PreProcTag"),
    ("haxeClassTag", "ClassTag"),
    ("haxeStructTag", "StructTag"),
    ("haxeFunctionTag", "FunctionTag"),
    ("haxeVariableTag", "VariableTag"),
    ("haxeExtensionTag", "ConstantTag"),
    ("haxeEnumTag", "EnumTag"),
    ("haxeMemberTag", "MemberTag"),
    ("haxeTypeTag", "TypeTag"),
    ("javaClassTag", "ClassTag"),
    ("javaEnumTag", "EnumTag"),
    ("javaEnumTypeTag", "EnumTypeTag"),
    ("javaFieldTag", "FieldTag"),
    ("javaInterfaceTag", "InterfaceTag"),
    ("javaMethodTag", "MethodTag"),
    ("javascriptClassTag", "ClassTag"),
    ("javascriptConstantTag", "ConstantTag"),
    ("javascriptFunctionTag", "FunctionTag"),
    ("javascriptMethodTag", "MethodTag"),
    ("javascriptObjectTag", "ObjectTag"),
    ("javascriptPropTag", "PreProcTag"),
    ("perlConstantTag", "ConstantTag"),
    ("perlFunctionTag", "FunctionTag"),
    ("perlPackageTag", "ModuleTag"),
    ("phpClassTag", "ClassTag"),
    ("phpConstantTag", "ConstantTag"),
    ("phpInterfaceTag", "InterfaceTag"),
    ("phpFunctionsTag", "FunctionTag"),
    ("pythonMethodTag", "MethodTag"),
    ("pythonFunctionTag", "FunctionTag"),
    ("pythonClassTag", "ClassTag"),
    ("pythonGlobalVarTag", "GlobalVarTag"),
    ("rubyModuleTag", "ModuleTag"),
    ("rubyClassTag", "ClassTag"),
    ("rubyMethodTag", "MethodTag"),
    ("rustImplementationTag", "TypeTag"),
    ("rustTraitInterfaceTag", "TypeTag"),
    ("rustStructTag", "TypeTag"),
    ("rustUnionTag", "UnionTag"),
    ("rustEnumTypeTag", "EnumTypeTag"),
    ("rustModuleTag", "PreProcTag"),
    ("rustEnumTag", "EnumTag"),
    ("rustFunctionTag", "FunctionTag"),
    ("rustMemberTag", "MemberTag"),
    ("rustMacroTag", "PreProcTag"),
    ("rustTypeTag", "TypeTag"),
    ("shFunctionTag", "FunctionTag"),
    ("shAliasTag", "PreProcTag"),
    ("vimFuncNameTag", "FunctionTag"),
    ("vimScriptFuncNameTag", "FunctionTag"),
    ("vimCommandTag", "PreProcTag"),
    ("vimAutoGroupTag", "PreProcTag"),
    ("vimVariableTag", "VariableTag"),
    ("zigClassTag", "ClassTag"),
    ("zigStructTag", "StructTag"),
    ("zigFunctionTag", "FunctionTag"),
    ("zigVariableTag", "VariableTag"),
    ("zigExtensionTag", "ConstantTag"),
    ("zigEnumTag", "EnumTag"),
    ("zigMemberTag", "MemberTag"),
    ("zigTypeTag", "TypeTag"),
    ("ClassTag", "TypeTag"),
    ("EnumTypeTag", "TypeTag"),
    ("StructTag", "TypeTag"),
    ("UnionTag", "TypeTag"),
    ("MethodTag", "FunctionTag"),
    ("VariableTag", "ObjectTag"),
    ("FieldTag", "MemberTag"),
    ("GlobalVarTag", "PreCondit"),
    ("ConstantTag", "Constant"),
    ("EnumTag", "Define"),
    ("FunctionTag", "Function"),
    ("InterfaceTag", "Identifier"),
    ("MemberTag", "Identifier"),
    ("ModuleTag", "PreProc"),
    ("ObjectTag", "Identifier"),
    ("PreProcTag", "PreProc"),
    ("TypeTag", "Type"),
]

# --- fixed values: built-in groups that win over the catalogue ---------------
RESTORED_GROUPS = {
    "c": ["cConstant", "cStorageClass", "cConditional", "cRepeat", "cType"],
    "cpp": ["cConstant", "cStorageClass", "cConditional", "cRepeat", "cType",
            "cppStorageClass", "cppType"],
}

# --- fixed values: exclusion patterns appended to every excluding rule -------
GLOBAL_NOTIN = [
    ".*String.*", ".*Comment.*", "cIncluded", "cCppOut2", "cCppInElse2",
    "cCppOutIf2", "pythonDocTest", "pythonDocTest2",
]

# --- fixed values: filetypes whose names may carry a scope ("s:name") ---------
SCOPED_FILETYPES = ("vim",)

# --- fixed values: filetypes that are never processed ------------------------
IGNORED_FILETYPES = [
    "cfg", "conf", "help", "mail", "markdown", "nerdtree", "nofile",
    "readdir", "qf", "text",
]

# --- fixed values: directories indexed file by file --------------------------
NORECURSE_DIRS = [
    "/", "/lib", "/include", "/usr/lib/", "/usr/share", "/usr/include",
    "/usr/local/lib", "/usr/local/share", "/usr/local/include",
]

# --- fixed values: names of generated files that are not indexed -------------
EXCLUDED_GLOBS = [
    "*Makefile", "*Makefile.in", "*aclocal.m4", "*config.guess",
    "*config.h.in", "*config.log", "*config.status", "*configure",
    "*depcomp", "*install-sh", "*missing", ".mypy_cache",
]

# --- fixed values: indexer language -> filetype ------------------------------
LANGUAGE_FILETYPE = [("C++", "cpp"), ("C#", "cs"), ("Sh", "zsh")]

# --- fixed values: filetype -> file name extensions --------------------------
FILETYPE_EXTENSIONS = {
    "python": ["py"],
    "perl": ["pl", "pm"],
    "cpp": ["cpp", "cxx", "c", "h", "hpp"],
    "c": ["c", "h"],
    "ruby": ["rb"],
    "javascript": ["js", "jsx", "vue"],
    "vue": ["js", "vue"],
    "typescript": ["ts", "tsx"],
}

# --- fixed values: known filetypes and the language each one stands for ------
LANGUAGES = [
    ("c", "c"), ("cpp", "cpp"), ("objc", "c"), ("objcpp", "cpp"), ("cs", "cs"),
    ("go", "go"), ("java", "java"), ("javascript", "javascript"),
    ("flow", "flow"), ("typescript", "typescript"), ("lisp", "lisp"),
    ("perl", "perl"), ("php", "php"), ("python", "python"), ("ruby", "ruby"),
    ("rust", "rust"), ("sh", "sh"), ("vim", "vim"), ("zsh", "zsh"),
    ("vue", "vue"), ("swift", "swift"), ("lua", "lua"), ("moon", "moon"),
    ("haxe", "haxe"), ("zig", "zig"),
]

# --- fixed values: languages whose comments and strings can be removed -------
COMMENT_FAMILY = {
    "clike": ["c", "cpp", "cs", "go", "java", "rust", "javascript",
              "typescript", "flow", "vue", "swift", "haxe", "zig"],
    "python": ["python"],
}

# --- fixed values: names that all mean the joint C / C++ catalogue -----------
C_FAMILY = ["c", "c++", "cpp", "objc", "objcpp"]

# --- fixed values: names in one rendered chunk -------------------------------
CHUNK_SIZE = 2048

# --- fixed values: event -> (action, forced) ---------------------------------
EVENT_ACTIONS = [
    ("BufWritePost", "update", True),
    ("BufReadPre", "highlight", False),
    ("BufEnter", "highlight", False),
    ("FileType", "rehighlight", True),
    ("Syntax", "rehighlight", True),
]

# --- fixed values: line rules (language, line regex, capture group, kind) ----
LINE_RULES = [
    ("Go", r"^\s*(var)?\s*(\w*)\s*:?=\s*func", 2, "f"),
    ("typescript", r"^[ \t]*(export([ \t]+abstract)?([ \t]+default)?)?[ \t]*class[ \t]+([a-zA-Z0-9_]+)", 4, "c"),
    ("typescript", r"^[ \t]*(declare)?[ \t]*namespace[ \t]+([a-zA-Z0-9_]+)", 2, "n"),
    ("typescript", r"^[ \t]*(export)?[ \t]*module[ \t]+([a-zA-Z0-9_]+)", 2, "M"),
    ("typescript", r"^[ \t]*(export)?[ \t]*function[ \t]+([a-zA-Z0-9_]+)", 2, "f"),
    ("typescript", r"^[ \t]*export[ \t]+(var|let|const)[ \t]+([a-zA-Z0-9_]+)", 2, "v"),
    ("typescript", r"^[ \t]*(var|let|const)[ \t]+([a-zA-Z0-9_]+)[ \t]*=[ \t]*function[ \t]*\(\)", 2, "V"),
    ("typescript", r"^[ \t]*(export)?[ \t]*(public|protected|private)[ \t]+(static)?[ \t]*([a-zA-Z0-9_]+)", 4, "m"),
    ("typescript", r"^[ \t]*(export)?[ \t]*interface[ \t]+([a-zA-Z0-9_]+)", 2, "i"),
    ("typescript", r"^[ \t]*(export)?[ \t]*type[ \t]+([a-zA-Z0-9_]+)", 2, "t"),
    ("typescript", r"^[ \t]*(export)?[ \t]*enum[ \t]+([a-zA-Z0-9_]+)", 2, "e"),
    ("typescript", r"^[ \t]*import[ \t]+([a-zA-Z0-9_]+)", 1, "I"),
    ("typescript", r"^[ \t]*@([A-Za-z0-9._$]+)[ \t]*", 1, "d"),
]

# --- fixed values: what must stand around an occurrence of a kind ------------
# (filetype, kind, rule). The rule names are explained in operators/spans.py.
CONTEXT_RULES = [
    ("c", "g", "after_enum"),
    ("c", "s", "after_struct"),
    ("c", "u", "after_union"),
    ("c", "m", "after_member_access"),
    ("c", "t", "no_member_access_follows"),
    ("c", "R", "after_ampersand"),
    ("cpp", "m", "after_member_access"),
    ("cpp", "f", "call_follows"),
    ("go", "m", "after_member_dot"),
    ("go", "f", "call_or_func_assignment_follows"),
    ("python", "m", "after_dot_or_def"),
    ("python", "f", "not_after_def"),
    ("perl", "s", "perl_call"),
    ("php", "f", "parenthesis_follows"),
    ("vim", "c", "vim_command"),
]
