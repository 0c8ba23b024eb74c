"""spatialseg.streaming"""
