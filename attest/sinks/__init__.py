"""Writers: reports, dataset cards, catalogue records, graphs, crates, project scaffolds."""
