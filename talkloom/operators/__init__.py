"""talkloom.operators"""
