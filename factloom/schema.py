"""Schemas of the fact tables, as Spark's readers take them.  Nothing is inferred from files."""

from __future__ import annotations

_PLACE = "path string, start_line int, start_col int, end_line int, end_col int"

TABLES: dict[str, str] = {
    "projects": "project string, file_path string, assembly string, is_test boolean, output_type string, tfms array<string>",
    "project_refs": "src_project string, dst_project string",
    "documents": "doc_id long, project string, path string, is_generated boolean, text string",
    "symbols": (
        "symbol_id string, name string, fqn string, kind string, type_kind string, accessibility string, modifiers array<string>, containing_type string, namespace string, project string, "
        + _PLACE
        + ", return_type string, params array<struct<kind:string,name:string>>, base_types array<string>, interfaces array<string>, has_getter boolean, has_setter boolean, setter_accessibility string, attributes array<string>, is_implicit boolean"
    ),
    "references": "ref_id long, target_symbol_id string, container_symbol_id string, " + _PLACE + ", classification string, usage_kind string, preview string",
    "call_edges": "caller_id string, callee_id string, path string, line int, col int",
    "inherit_edges": "child_id string, parent_id string, kind string",
    "access_edges": "type_id string, method string, member string, member_kind string",
    "tokens": "doc_id long, ord int, kind string, text string, line int, col int",
    "syntax_nodes": "node_id long, parent_id long, doc_id long, member_id string, kind string, depth int, ord int, start_line int, start_col int, end_line int, end_col int, text string",
    "imports": "doc_id long, file_namespace string, used_namespace string, is_global boolean, is_static boolean",
    "diagnostics": "diag_id long, source string, id string, message string, severity string, category string, project string, " + _PLACE,
    "rules": "id string, title string, category string, default_severity string, enabled boolean, help string",
    "security_rules": "id string, security_category string, owasp string, security_severity string, fix_hint string",
    "package_refs": "project string, package_id string, version string, resolved_central_version string",
    "vulnerabilities": "package_id string, resolved_version string, severity string, advisory_url string, project string, is_transitive boolean, patched_version string",
    "di_registrations": "service_type string, impl_type string, lifetime string, path string, line int, method string",
    "catch_sites": "path string, line int, method string, declared_type string, has_filter boolean, body string, rethrow_type string",
    "tests": "project string, display_name string, fqn string, path string, line int",
    "coverage_lines": "module string, class string, line int, hits long",
    "var_events": "body_id string, local_id string, name string, event string, line int",
    "changes": "seq long, workspace string, description string, files array<string>, tool string, applied_at timestamp",
}
