"""name -> (query, oracle SQL), gathered from the catalogue modules."""

from massloom.plans import catalog_build, catalog_cluster, catalog_export, catalog_io, catalog_joins, catalog_models, catalog_more, catalog_paths, catalog_profiles, catalog_rates, catalog_resolve, catalog_scores, catalog_search, catalog_select, catalog_space, catalog_tandem

CATALOG = {name: entry for module in (catalog_joins, catalog_cluster, catalog_select, catalog_scores, catalog_space, catalog_io, catalog_more, catalog_tandem, catalog_rates, catalog_profiles, catalog_build, catalog_export, catalog_models, catalog_search, catalog_resolve, catalog_paths) for name, entry in module.CATALOG.items()}
