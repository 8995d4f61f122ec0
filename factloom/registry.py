"""The catalogue of what this engine answers: each capability, how it is met, and where.

Kinds: query (computed here), parsed (facts produced by a tool outside, read
here), staged (a change: what it touches is a query, the change itself a
staged set of rows), session (state of the engine), outside (needs a compiler,
a formatter or a template, and is not done here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paging import clamp

#: Fixed values, one line each: category | capability | kind | module.function | query.
_TEXT = """
symbols | symbol_search | query | lookup.symbol_search | symbol_search
symbols | symbol_info | query | lookup.by_id | symbol_info
symbols | go_to_definition | query | lookup.by_id | go_to_definition
symbols | find_references | query | lookup.find_references | find_references
symbols | find_implementations | query | lookup.preferred | find_implementations
symbols | document_symbols | query | graph.hierarchy | document_symbols
symbols | get_symbol_outline | query | graph.outline | symbol_outline
symbols | find_overrides | query | graph.overrides | override_roots
symbols | find_base_members | query | graph.ancestors | base_members
symbols | member_hierarchy | query | graph.hierarchy | member_hierarchy
symbols | symbol_signature_help | query | lookup.signatures | signature_help
symbols | symbol_relationships | query | graph.impact_rows | relationship_places
symbols | find_references_bulk | query | lookup.find_references_bulk | find_references_bulk
symbols | find_type_consumers | query | deps.consumers | type_consumers
symbols | find_property_writes | query | usages.property_writes | property_write_kinds
symbols | probe_position | query | lookup.enclosing | probe_position
symbols | enclosing_symbol | query | lookup.enclosing | enclosing_long_spans
symbols | goto_type_definition | query | lookup.by_id | goto_type_definition
symbols | get_completions | query | lookup.completions | completions
analysis | project_diagnostics | query | diagnostics.diagnostics | diagnostics
analysis | diagnostic_details | query | diagnostics.details | diagnostic_details
analysis | type_hierarchy | query | graph.hierarchy | type_hierarchy
analysis | callers_callees | query | graph.callers_callees | callers_callees
analysis | impact_analysis | query | graph.impact_rows | impact_places
analysis | find_type_mutations | query | deps.mutations | type_mutations
analysis | find_type_usages | query | usages.type_usages | type_usage_classes
analysis | semantic_grep | query | search.grep | semantic_grep
analysis | list_analyzers | query | paging.page | list_analyzers
analysis | get_cohesion_metrics | query | graph.clusters | cohesion_clusters
analysis | find_shared_members | query | graph.shared_members | shared_members
analysis | find_consumers | query | deps.consumers | consumers
analysis | get_coupling_metrics | query | graph.coupling | coupling_metrics
analysis | symbol_impact_sweep | query | mirrored.one_sided | impact_one_sided
analysis | preview_record_field_addition | query | deps.record_sites | record_field_addition
analysis | analyze_snippet | outside | |
advanced-analysis | find_unused_symbols | query | unused.unused | unused_by_rules
advanced-analysis | get_di_registrations | query | deps.registrations | di_override_chains
advanced-analysis | get_complexity_metrics | query | metrics.method_metrics | method_metrics
advanced-analysis | find_reflection_usages | query | usages.reflection_calls | reflection_calls
advanced-analysis | get_namespace_dependencies | query | graph.dependency_graph | namespace_graph
advanced-analysis | get_nuget_dependencies | query | deps.packages | nuget_dependencies
advanced-analysis | find_dead_locals | query | dead.dead_locals | dead_locals
advanced-analysis | find_dead_fields | query | dead.dead_fields | dead_fields
advanced-analysis | find_duplicate_helpers | query | dead.duplicate_helpers | duplicate_helpers
advanced-analysis | find_duplicated_methods | query | dead.duplicate_bodies | duplicated_bodies
advanced-analysis | find_duplicated_code | query | dead.duplicate_bodies | duplicated_turns
advanced-analysis | semantic_search | query | search.semantic_search | semantic_search_structured
advanced-analysis | trace_exception_flow | query | diagnostics.caught_page | exception_flow_page
advanced-analysis | analyze_data_flow | query | dead.data_flow | data_flow
advanced-analysis | analyze_control_flow | query | graph.control_flow | control_flow_points
advanced-analysis | get_operations | query | graph.subtree | operations_subtree
advanced-analysis | suggest_refactorings | query | metrics.suggestions | suggest_refactorings
validation | compile_check | query | diagnostics.diagnostics | compile_check
validation | verify_pragma_suppresses | query | diagnostics.suppressed | verify_suppression
validation | test_coverage | parsed | captured.coverage_lines | test_coverage
validation | get_test_coverage_map | parsed | captured.coverage_lines | test_coverage_map
validation | test_reference_map | query | metrics.reference_map | test_reference_map
validation | validate_workspace | query | diagnostics.status | validate_workspace
validation | validate_recent_git_changes | parsed | captured.changed_files | validate_recent_changes
validation | build_workspace | parsed | captured.build_diagnostics | build_workspace
validation | build_project | parsed | captured.build_diagnostics | build_project
validation | test_discover | query | testing.discovered | test_discover
validation | test_run | parsed | captured.test_results | test_run
validation | test_related | query | testing.related | test_related
validation | test_related_files | query | testing.related_by_terms | related_tests_by_terms
security | security_diagnostics | query | diagnostics.security | security_diagnostics
security | security_analyzer_status | query | deps.presence | security_analyzer_status
security | nuget_vulnerability_scan | parsed | captured.vulnerable_packages | vulnerability_scan
workspace | workspace_load | session | session.load | workspace_load
workspace | workspace_reload | session | session.reload | workspace_reload
workspace | workspace_close | session | session.close | workspace_close
workspace | workspace_list | session | session.listed | workspace_list
workspace | workspace_status | session | session.status | workspace_status
workspace | workspace_health | session | session.described | workspace_verbose
workspace | project_graph | query | graph.neighbours | project_graph
workspace | source_generated_documents | query | lookup.preferred | source_generated_documents
workspace | get_source_text | query | changes.text_slice | get_source_text
workspace | workspace_changes | session | session.changes | workspace_log
workspace | workspace_warm | session | session.warm | workspace_warm
server | server_info | session | registry.counts | server_info
server | server_heartbeat | session | registry.heartbeat | server_heartbeat
refactoring | bulk_replace_type_preview | staged | changes.affected_files | bulk_replace_type
refactoring | bulk_replace_type_apply | staged | session.apply | bulk_replace_type_apply
refactoring | replace_invocation_preview | staged | rewrites.reordered | change_signature
refactoring | change_signature_preview | staged | rewrites.shared_edits | change_signature_preview
refactoring | extract_method_preview | staged | dead.data_flow | extract_method_preview
refactoring | extract_method_apply | staged | session.apply | extract_method_apply
refactoring | extract_shared_expression_to_helper_preview | staged | dead.duplicates | extract_shared_expression
refactoring | fix_all_preview | staged | changes.affected_files | fix_all_preview
refactoring | fix_all_apply | staged | session.apply | fix_all_apply
refactoring | extract_interface_preview | staged | rewrites.extracted_interface | extract_interface_preview
refactoring | extract_interface_apply | staged | session.apply | extract_interface_apply
refactoring | rename_preview | staged | changes.affected_files | rename_preview
refactoring | rename_apply | staged | session.apply | rename_apply
refactoring | organize_usings_preview | staged | rewrites.organised | organize_usings
refactoring | organize_usings_apply | staged | session.apply | organize_usings_apply
refactoring | format_document_preview | outside | |
refactoring | format_document_apply | staged | session.apply | format_document_apply
refactoring | code_fix_preview | staged | changes.difference | code_fix_preview
refactoring | code_fix_apply | staged | session.apply | code_fix_apply
refactoring | format_range_preview | outside | |
refactoring | format_range_apply | staged | session.apply | format_range_apply
refactoring | format_check | outside | |
refactoring | restructure_preview | staged | changes.restructured | restructure_nested
refactoring | replace_string_literals_preview | staged | changes.replace_literals | replace_literals
refactoring | symbol_refactor_preview | staged | changes.fold | symbol_refactor_preview
refactoring | split_service_with_di_preview | staged | rewrites.partitioned | split_service
refactoring | record_field_add_with_satellites_preview | staged | rewrites.satellites | record_satellites
refactoring | extract_type_preview | staged | changes.replaced | extract_type_preview
refactoring | extract_type_apply | staged | session.apply | extract_type_apply
refactoring | move_type_to_file_preview | staged | changes.difference | move_type_to_file_preview
refactoring | move_type_to_file_apply | staged | session.apply | move_type_to_file_apply
refactoring | change_type_namespace_preview | staged | rewrites.relocated | change_type_namespace
project-mutation | evaluate_msbuild_property | parsed | captured.properties | evaluate_property
project-mutation | evaluate_msbuild_items | parsed | captured.items | project_items
project-mutation | get_msbuild_properties | parsed | captured.properties | project_properties
project-mutation | add_package_reference_preview | staged | changes.inserted | add_package_reference
project-mutation | remove_package_reference_preview | staged | changes.without | remove_package_reference
project-mutation | add_project_reference_preview | staged | changes.inserted | add_project_reference
project-mutation | remove_project_reference_preview | staged | changes.without | remove_project_reference
project-mutation | set_project_property_preview | staged | changes.upsert | set_project_property
project-mutation | add_target_framework_preview | staged | rewrites.with_element | target_frameworks
project-mutation | remove_target_framework_preview | staged | rewrites.with_element | remove_target_framework
project-mutation | set_conditional_property_preview | staged | changes.upsert | set_conditional_property
project-mutation | add_central_package_version_preview | staged | changes.upsert | add_central_package_version
project-mutation | remove_central_package_version_preview | staged | changes.without | remove_central_package_version
project-mutation | apply_project_mutation | staged | session.apply | apply_project_mutation
editing | apply_text_edit | staged | changes.apply_edits | apply_text_edit
editing | apply_multi_file_edit | staged | changes.apply_edits | apply_multi_file_edit
editing | preview_multi_file_edit | staged | changes.difference | preview_multi_file_edit
editing | preview_multi_file_edit_apply | staged | session.apply | preview_multi_file_edit_apply
editing | add_pragma_suppression | staged | rewrites.suppressions | add_pragma_suppression
editing | pragma_scope_widen | staged | rewrites.widened | pragma_scope_widen
file-operations | create_file_preview | staged | changes.file_checks | create_file_preview
file-operations | create_file_apply | staged | session.apply | create_file_apply
file-operations | delete_file_preview | staged | changes.file_checks | delete_file_preview
file-operations | delete_file_apply | staged | session.apply | delete_file_apply
file-operations | move_file_preview | staged | changes.file_checks | move_file_preview
file-operations | move_file_apply | staged | session.apply | move_file_apply
scaffolding | scaffold_type_preview | outside | |
scaffolding | scaffold_test_batch_preview | outside | |
scaffolding | scaffold_type_apply | staged | session.apply | scaffold_type_apply
scaffolding | scaffold_test_preview | outside | |
scaffolding | scaffold_test_apply | staged | session.apply | scaffold_test_apply
scaffolding | scaffold_first_test_file_preview | outside | |
orchestration | migrate_package_preview | staged | changes.upsert | migrate_package
orchestration | split_class_preview | staged | rewrites.split | split_class_preview
orchestration | extract_and_wire_interface_preview | staged | rewrites.rewired | extract_and_wire_interface
orchestration | apply_composite_preview | staged | session.apply | apply_composite
undo | apply_with_verify | staged | diagnostics.new_errors | apply_with_verify
undo | revert_last_apply | staged | changes.last_change | revert_last_apply
undo | revert_apply_by_sequence | staged | changes.revertible | revert_by_sequence
code-actions | get_code_actions | parsed | diagnostics.fixes | code_actions
code-actions | preview_code_action | staged | diagnostics.fix_at | code_action_at
code-actions | apply_code_action | staged | session.apply | apply_code_action
cross-project-refactoring | move_type_to_project_preview | staged | changes.conflicts | move_conflicts
cross-project-refactoring | extract_interface_cross_project_preview | staged | changes.conflicts | extract_interface_cross_project
cross-project-refactoring | dependency_inversion_preview | staged | rewrites.inverted | dependency_inversion
dead-code | remove_dead_code_preview | staged | dead.removable | remove_dead_code
dead-code | remove_dead_code_apply | staged | session.apply | remove_dead_code_apply
dead-code | remove_interface_member_preview | staged | rewrites.removable_members | remove_interface_member
configuration | get_editorconfig_options | query | lookup.effective_options | effective_options
configuration | set_editorconfig_option | staged | changes.upsert | set_editorconfig_option
configuration | set_diagnostic_severity | staged | rewrites.effective_severity | set_diagnostic_severity
prompts | get_prompt_text | outside | |
scripting | evaluate_csharp | outside | |
syntax | get_syntax_tree | query | changes.budgeted | syntax_tree_budget
"""

CATALOGUE: list[tuple[str, str, str, str | None, str | None]] = []
for _line in _TEXT.strip().splitlines():
    _part = [x.strip() or None for x in _line.split("|")]
    CATALOGUE.append((_part[0], _part[1], _part[2], _part[3], _part[4] if len(_part) > 4 else None))


def catalogue(spark: SparkSession, offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of the catalogue (category, capability, kind, operator, query)."""
    rows = spark.createDataFrame(CATALOGUE, "category string, capability string, kind string, operator string, query string")
    return rows.orderBy("category", "capability").offset(max(0, offset)).limit(clamp(limit, 1, 200))


def counts(spark: SparkSession) -> DataFrame:
    """How many capabilities of each kind there are."""
    return catalogue(spark).groupBy("kind").agg(F.count("*").alias("n"))


def heartbeat(spark: SparkSession) -> DataFrame:
    """One row that only a live session gives (version, alive)."""
    return spark.range(1).select(F.lit(spark.version).alias("version"), (F.col("id") == 0).alias("alive"))
