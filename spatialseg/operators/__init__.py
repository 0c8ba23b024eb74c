"""spatialseg.operators"""
