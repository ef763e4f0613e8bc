"""Plan helpers: sessions, shared scratch tables, sized broadcasts."""
