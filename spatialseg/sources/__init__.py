"""spatialseg.sources"""
