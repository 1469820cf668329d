"""Rule packs, lexicons and taxonomies."""
